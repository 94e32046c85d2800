from collections import defaultdict

import numpy as np

from tests.conftest import SF
from threadloom.llm import embedding_dedup
from threadloom.llm.queries import op10_embedding_dedup


def brute(rows):
    own, by = {}, defaultdict(list)
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
            by[label, len(v)].append(i)
    links, parent = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for ids in by.values():
        m = np.array([own[i] for i in ids])
        for a, b in zip(*np.nonzero(m @ m.T >= 0.98), strict=True):
            if a < b:
                links[ids[a]] += 1
                links[ids[b]] += 1
                p, q = root(ids[a]), root(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], root(i), root(i) == i) for i in links}


def result(frame):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in frame.collect()}


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert result(op10_embedding_dedup(spark, SF)) == brute(rows)


def test_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 64))
    rows = [(i, [float(x) for x in np.float32(base[i % 3 if i < 150 else i % 6] + rng.normal(size=64) * 0.09)], i % 2) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0], 0) for i in range(40)] + [(2000, [2.0, 4.0], 0), (2001, [2.0, 4.1], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, wanted = result(embedding_dedup.near_duplicates(docs)), brute([(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows])
    pairs = sum(w[0] for w in wanted.values())
    assert pairs > 5000 and all(found[i][0] <= wanted[i][0] for i in wanted)
    assert sum(f[0] for f in found.values()) >= 0.99 * pairs
    assert {i: found[i] for i in wanted if i >= 1000} == {i: wanted[i] for i in wanted if i >= 1000}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [None, 1.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, 1.0], None), (7, [1.0, 1.0], 1), (8, [1.0, 1.0], 1), (9, [1.0, 1.0, 1.0], 1), (8, [1.0, 1.0], 1), (None, [0.0, 1.0], 2), (None, None, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as key", "'x' as n_links")
    found = [tuple(r) for r in embedding_dedup.near_duplicates(docs).collect()]
    lone = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 6, 9)]
    assert sorted(found, key=str) == sorted([*lone, (7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (None, 0, None, True), (None, 0, None, True)], key=str)
    assert embedding_dedup.near_duplicates(docs.limit(0)).count() == 0
