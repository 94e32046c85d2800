import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from threadloom.llm import mixing
from threadloom.llm.queries import op8_mixing


def targets(sizes):
    """The contract in words: share by weight, cap at three times, share the excess anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        left = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_query(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = {r["doc_id"]: r["source"] for r in read}
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in read}
    rows = op8_mixing(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == docs.keys() and len(rows) == len(docs)
    assert {r["doc_id"]: r["size"] for r in rows} == words
    # What the mix itself holds, counted from the texts it gives out.
    given = Counter()
    for r in mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "text").collect():
        given[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {r["doc_id"]: r["taken"] for r in rows if r["taken"]} == {i: n for i, n in given.items() if n}
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[docs[r["doc_id"]]] += r["size"]
        taken[docs[r["doc_id"]]] += r["taken"]
        largest[docs[r["doc_id"]]] = max(largest[docs[r["doc_id"]]], r["size"])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    wanted = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[docs[r["doc_id"]]] and r["target"] == pytest.approx(wanted[docs[r["doc_id"]]])
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= largest[source]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op8_mixing(spark, SF).collect()))


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 10, "d": 1}, {"a": 5, "b": 1000, "c": 1000, None: 7}, {"a": 0, "b": 3}, {"z": 9}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, i, n) for i, (s, n) in enumerate(sizes.items())], "source string, source_key long, source_size long")
    assert {r["source"]: r["target"] for r in mixing.targets(rows).collect()} == pytest.approx(targets(sizes))


def test_hypergeometric(spark):
    total, marked, drawn, n = 30, 12, 10, 2000
    u = (F.col("id") + 0.5) / n
    found = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(*[F.lit(x).cast("long") for x in (total, marked, drawn)], u)).collect())
    for k in range(drawn + 1):
        p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert found[k] == pytest.approx(n * p, abs=1.01)
    edge = spark.range(1).select(*[mixing.hypergeometric(*[F.lit(x).cast("long") for x in args], F.lit(0.999)) for args in ((5, 5, 2), (5, 0, 2), (5, 2, 0), (0, 0, 0), (4000, 3999, 2000))]).first()
    assert tuple(edge)[:4] == (2, 0, 0, 0) and edge[4] in (1999, 2000)


def test_split_quotas(spark):
    quotas = {1: 700, 2: 30, 3: 1}
    rows = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "source_key long, quota long"), 8, 0).collect()
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in rows:
        by_source[r["source_key"]] += r["n"]
        by_shard[r["shard"]] += r["n"]
    assert by_source == quotas and max(by_shard.values()) - min(by_shard.values()) <= 3 and len(by_shard) == 8


def test_documents_larger_than_a_target(spark):
    rows = [(i, "w " * 20, "a") for i in range(100)] + [(1000, "w " * 200_000, "b"), (1001, None, "b"), (2000, "w " * 30, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in mixing.plan(docs).collect()}
    wanted = targets({"a": 2000, "b": 200_000, "c": 30})
    assert len(found) == len(rows) and found[1000]["size"] == 200_000 and found[1001]["size"] == 0
    assert all(found[i]["target"] == pytest.approx(wanted[s]) and len(found[i]["draws"]) <= 3 for i, _, s in rows)
    taken = found[1000]["size"] * len(found[1000]["draws"])
    assert abs(taken - wanted["b"]) <= 200_000 / 2 and len(found[2000]["draws"]) == 3


def test_mixed_repeats_what_the_plan_takes(spark):
    rows = [(i, "w " * (i % 7), "abc"[i % 3 if i < 60 else 0]) for i in range(400)] + [(1000, None, None), (None, "x y", "b"), (5, "w " * 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as shard", "2 as size", "3 as draws")
    mix = mixing.mixed(docs, blocks=16, shards=4).collect()
    planned = mixing.plan(docs, blocks=16, shards=4).collect()
    assert len(planned) == len(rows)
    assert Counter(r["doc_id"] for r in mix) == Counter({k: v for k, v in _sum((r["doc_id"], len(r["draws"])) for r in planned).items() if v})
    assert {r["shard"] for r in mix} <= set(range(4)) and set(docs.columns) <= set(mix[0].asDict())
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def _sum(pairs):
    found = Counter()
    for k, v in pairs:
        found[k] += v
    return found
