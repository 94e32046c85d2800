import math
import os
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from threadloom import storage
from threadloom.llm import simhash
from threadloom.llm.components import components
from threadloom.llm.queries import op7_simhash


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate(dict.fromkeys([32, *range(9, 14)], " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps):
    """fps: id to fingerprint; id to the smallest id of its component."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(values[i] ^ values) <= 3)[0]:
            p, q = root(i), root(int(j))
            parent[max(p, q)] = min(p, q)
    return {i: ids[root(k)] for k, i in enumerate(ids)}


def test_query_equals_brute_force(spark):
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    groups = grouped(fps)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op7_simhash(spark, SF).collect()}
    assert found == {i: (f"{f:016x}", groups[i]) for i, f in fps.items()}


@pytest.mark.parametrize("block", [1024, 4])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", min(block, simhash.FEW))
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64).tolist()
    fps = {}
    for i in range(300):
        x = base[i % (3 if i < 150 else 12)]
        for _ in range(int(rng.integers(0, 5))):
            x ^= 1 << int(rng.integers(0, 64))
        fps[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(0, signed(x)) for x in set(fps.values())], "table int, fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(rows).select("a", "b")).collect()}
    one, two = defaultdict(set), defaultdict(set)
    for i, x in fps.items():
        one[roots.get(signed(x), signed(x))].add(i)
    for i, g in grouped(fps).items():
        two[g].add(i)
    assert sorted(map(sorted, one.values())) == sorted(map(sorted, two.values()))


def shingles(text, size=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([32, *range(9, 14)], " ")).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar_groups(rows):
    """rows: (id, text) with distinct ids; id to the smallest id of its group by brute force over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_representatives_of_similar_texts(spark):
    rng = np.random.default_rng(0)
    rows = []
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(80, 400)))]
        for _ in range(int(rng.integers(1, 6))):
            own = list(words)
            for _ in range(int(rng.integers(0, 1 + len(words) // 45))):
                own[int(rng.integers(0, len(own)))] = f"edit{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + i, " ".join(rng.permutation(rows[0][1].split()))) for i in range(3)]  # the same words, but not the same text
    groups = similar_groups(rows)
    kept = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wanted = set(groups.values())
    assert wanted <= kept and len(kept) <= len(wanted) + 0.08 * (len(rows) - len(wanted)) and len(wanted) < len(rows) - 60


def test_recall_over_a_whole_table(spark):
    """Similar pairs of all sf0.1 documents, found by brute force over each text's rarest fifth of shingles, of which similar texts share one."""
    docs = spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text")
    texts = {}
    for i, text in sorted(map(tuple, docs.collect())):
        texts.setdefault(text or "", i)
    sets = {i: simhash.shingle_hashes(t, 5) for t, i in texts.items()}
    often = Counter(h for own in sets.values() for h in own.tolist())
    holders, pairs = defaultdict(list), set()
    for i, own in sets.items():
        for h in sorted(own.tolist(), key=lambda h: (often[h], h))[: len(own) - math.ceil(0.8 * len(own)) + 1]:
            holders[h].append(i)
    for i, j in {pair for ids in holders.values() for pair in combinations(ids, 2)}:
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if shared >= 0.8 * (len(a) + len(b) - shared):
                pairs.add((i, j))
    kept = {r["doc_id"] for r in simhash.representatives(docs).collect()}
    missed = [p for p in pairs if p[0] in kept and p[1] in kept]
    assert len(pairs) == 48 and len(missed) <= 0.02 * len(pairs)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(edges.limit(0)).count() == 0


def test_edge_cases(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (None, "only one here"), (7, "Same Text of words"), (8, "same text\tof  words"), (8, "same text\tof  words"), (9, "a " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as component_id")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(3, 1), (1, 1), (2, 1), (None, None), (7, 7), (8, 7), (8, 7), (9, 9)], key=str)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, None, 7, 9], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.fingerprint("a " * 300_000) == fingerprint("a a a")


def test_groups_that_share_an_id_each_keep_a_row(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white")
    rows = [(None, one), (None, two), (None, two), (5, three), (2, "uno dos tres cuatro cinco"), (5, "uno dos tres cuatro cinco"), (6, three), (None, three), (6, "ein zwei drei vier")]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, one), (None, two), (5, three), (2, rows[4][1]), (6, rows[8][1])], key=str)


@pytest.mark.parametrize("block", [1024, 2])
def test_no_similar_pair_is_left_out(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "FEW", min(block, simhash.FEW))
    monkeypatch.setattr(simhash, "OFTEN", 4)
    rng = np.random.default_rng(5)
    rows, common = [], [f"c{i}" for i in range(12)]
    for base in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(6, 120)))] + common  # all share some shingles
        for k in range(4):
            own = list(words)
            own[len(own) // 2 : len(own) // 2 + int(rng.integers(0, 2 + len(words) // 9))] = [f"n{base}x{k}x{i}" for i in range(int(rng.integers(0, 3)))]
            rows.append((len(rows), " ".join(own)))
    kept = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(similar_groups(rows).values()) and 60 < len(kept) < 200


def test_rarest_shingles_meet_whatever_is_frequent():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        a, b = pool[:n], np.sort(rng.choice(pool[: n + 3], min(n, len(pool[: n + 3])), replace=False))
        shared = len(np.intersect1d(a, b))
        often = np.sort(rng.permutation(pool)[: int(rng.integers(0, len(pool)))])
        rank = rng.permutation(len(often))
        assert np.bitwise_count((simhash.parities(a) ^ simhash.parities(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))
        if shared >= 0.8 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(simhash.rarest(a, 0.8, often, rank), simhash.rarest(b, 0.8, often, rank)))


def test_shingle_sets_are_deleted_once_compared(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(60)) + (" tail" if i > 2 else "")) for i in range(6)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.representatives(docs).collect()) == [0, 1, 2]
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert any(x.startswith("similar-texts") for x in os.listdir(folder)) and not any(x.startswith("shingle-sets") for x in os.listdir(folder))


def test_wide_parities_tell_long_texts_apart(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1100, 2000, 2200, 5000)]
    sets.append(np.sort(np.concatenate([sets[2][:1900], sets[0][:100]])))  # similar to the third
    pairs = [(i, j) for i in range(5) for j in range(5)]
    rows = [(i, j, simhash.wide_parities(sets[i]).tolist(), simhash.wide_parities(sets[j]).tolist()) for i, j in pairs]
    found = spark.createDataFrame(rows, "i int, j int, x array<long>, y array<long>").select("i", "j", simhash._differing(F.col("x"), F.col("y")).alias("n")).collect()
    for i, j, n in found:
        bound = (len(sets[i]) + len(sets[j])) / 9
        assert n <= len(np.setxor1d(sets[i], sets[j])) and (n > bound) == (i != j and {i, j} != {2, 4})
    # 1,024 buckets, all that there were before, tell none of these long texts apart.
    assert np.bitwise_count((simhash.parities(sets[3]) ^ simhash.parities(np.flip(sets[3] + np.uint64(1 << 20)))).view(np.uint64)).sum() < 2 * len(sets[3]) / 9
    assert simhash.wide_parities(sets[0][:1024]) is None and simhash.wide_parities(sets[0][:0]) is None


def test_near_dedup_leaves_no_shuffle_files_and_no_large_tables(spark):
    docs = spark.createDataFrame([(i, " ".join(f"v{i % 4}x{k}" for k in range(1500)) + (" tail" if i > 3 else "")) for i in range(8)], "doc_id long, text string").repartition(3)
    folder = spark.conf.get("spark.checkpoint.dir", None) or storage.shared_dir(spark)
    before = set(os.listdir(folder.removeprefix("file://")))
    kept = simhash.representatives(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder.removeprefix("file://"))) - before}
    assert left == {"similar-texts", "kept-texts"}
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3]


def test_staged_tables_leave_no_shuffle_files(spark):
    def shuffles():
        folders = [Path(x.getPath()) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        return {p.name for f in folders for p in f.rglob("shuffle_*")}

    before = shuffles()
    table = storage.staged(spark.range(1000).repartition(5).groupBy(F.col("id") % 7).count(), "counted")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
