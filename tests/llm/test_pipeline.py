from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_quality_rules import verdicts
from tests.llm.test_simhash import similar_groups
from threadloom.llm import quality_model
from threadloom.llm.common import staged
from threadloom.llm.queries import op1_byte_bpe


def test_stages_work_on_what_is_left(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "SimHash near-dedup", "mixing sources", "byte-level BPE"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        found = out.collect()
        if name == "quality rules":
            wanted = verdicts([(r["source"], r["text"]) for r in rows])
            assert {r["doc_id"] for r in found} == {r["doc_id"] for r in rows if wanted[r["source"], r["text"] or ""][1]}
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = {r["doc_id"] for r in rows} - {r["doc_id"] for r in found}
            assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in rows} and sum(labels.get(i, 0) for i in gone) <= 2
        if name == "SimHash near-dedup":
            groups = similar_groups([(r["doc_id"], r["text"]) for r in rows])
            kept, wanted = {r["doc_id"] for r in found}, set(groups.values())
            assert len(kept) == len(found) and wanted <= kept and len(kept - wanted) <= 2
        if name == "mixing sources":
            assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in rows} and len(found) > len({r["doc_id"] for r in found})
        if name != "byte-level BPE":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(found, docs.schema)
            rows = found
        else:
            assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in rows) and out.columns == op1_byte_bpe(spark, SF).columns


def test_run(spark):
    found = corpus_pipeline.run(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = Counter(r["doc_id"] for r in found)
    base = {r["doc_id"] for r in docs.values() if verdicts([(r["source"], r["text"])])[r["source"], r["text"] or ""][0]}
    assert 0 < len(ids) < len(docs) and ids.keys() <= docs.keys() - base and max(ids.values()) <= 3
    assert all(r["n_tokens"] > 0 for r in found)


LONG = " ".join(f"word{i}" for i in range(60))


def tables(spark, tmp_path, rows):
    extra = ["1 as shard", "2 as position", "3 as score", "4 as key", "5 as fp", "'x' as row", "6 as removed", "7 as host_key", "8 as draws"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(40)] + [(None, 1, None), (3, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_on_edge_cases(spark, tmp_path):
    good = [(i, f"{LONG} and good words number {i} " + " ".join(f"good{i}x{k}" for k in range(60)), "en", f"s{i % 3}", None) for i in range(1, 40, 2)]
    bad = [(i, " ".join(f"BAD{i}x{k}!!" for k in range(120)), None, None, 5) for i in range(0, 40, 2)]
    odd = [(None, None, None, None, None), (50, "", "en", "s0", 0), (51, " \n\t", "en", "s1", 0), (None, good[0][1], "en", "s0", 1), (1, good[0][1], "en", "s1", 1), (1, good[0][1], "en", "s1", 1)]
    odd += [(60, " ".join(f"long{k}" for k in range(300_000)), "en", "s2", 1), (61, f"{good[3][1]}", "en", None, 1)]
    found = corpus_pipeline.run(spark, tables(spark, tmp_path, good + bad + odd)).collect()
    ids = {r["doc_id"] for r in found}
    assert not ids & {None, 50, 51, 61} and ids <= {1, 60, *range(3, 40)} and len(ids & set(range(1, 40, 2))) > 3
    assert all(r["n_tokens"] > 300_000 for r in found if r["doc_id"] == 60)


def test_run_on_empty_tables(spark, tmp_path):
    found = corpus_pipeline.run(spark, tables(spark, tmp_path, []))
    assert found.count() == 0 and found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_classifier_drops_all_below_one_half(spark):
    docs = staged(corpus_pipeline.rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "ruled")
    scores = {r["doc_id"]: r["score"] for r in quality_model.scores(docs, *quality_model.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert any(0.05 <= s < 0.5 for s in scores.values())
    assert {r["doc_id"] for r in corpus_pipeline.classifier(spark, docs, SF).collect()} == {i for i, s in scores.items() if s >= 0.5}


def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r["doc_id"] for r in corpus_pipeline.classifier(spark, docs, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(quality_model.held_out(F.col("doc_id"))).collect()
    good, bad = ({r["doc_id"] for r in labels if r["quality"] == q} for q in (1, 0))
    assert len(bad & left) <= 0.1 * len(bad) and len(good - left) <= 0.02 * len(good) and bad and good
