import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.llm import quality_model
from threadloom.llm.queries import op6_quality_model

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = op6_quality_model(spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 80 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    loss = -np.mean([np.log(max(1e-9, s if y else 1 - s)) for s, y in held])
    assert loss < 0.15  # calibrated: sure where it is right


def contexts(texts):
    """Word vectors by definition, from pairs of units up to WINDOW apart."""
    places, signs = quality_model._index_vectors()
    total = np.zeros((quality_model.BUCKETS, quality_model.DIMENSIONS))
    for text in texts:
        units, last = [], None
        for word in (text or "").split():
            code = quality_model._units[word]
            units += [u - 1 for u in (code & 0xFFFF, code >> 16) if u] + [quality_model.REPEAT] * (word == last)
            last = word
        for i, u in enumerate(units):
            for j in range(max(0, i - quality_model.WINDOW), min(len(units), i + quality_model.WINDOW + 1)):
                if i != j:
                    for k in range(quality_model.NONZERO):
                        total[u, places[units[j], k]] += signs[units[j], k]
    return total / np.maximum(np.sqrt((total**2).sum(axis=1, keepdims=True)), 1e-9)


def test_word_vectors_equal_brute_force(spark, monkeypatch):
    texts = ["a b c d", "A b!! b!! c", None, "", "x", "b b b *** e-f", "c d " * 50]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert np.allclose(quality_model.word_vectors(docs), contexts(texts), atol=1e-6)


def test_units_of_words():
    letters, marks = quality_model.re.compile(r"[^\W_]+"), {}
    for word in ["a", "Ab", "ab.", "AB", "AB!", "a_", "_", "...", "e-f", "x\u0301", "don't", "..a", "a.b.", "\u03a3\u03a3", "1", "1,"]:
        code = quality_model._units[word]
        own = "".join(letters.findall(word)).lower()
        core, mark = (code & 0xFFFF) - 1, (code >> 16) - 1
        assert core == (quality_model.xxhash.xxh64_intdigest(own) % (quality_model.BUCKETS - quality_model.MARKS) if own else -1)
        marks.setdefault("".join(sorted(set(letters.sub("", word)))) + "A" * (len(own) > 1 and word.isupper()), set()).add(mark)
    assert all(len(x) == 1 for x in marks.values()) and marks[""] == {-1}


def test_features_do_not_depend_on_batches(monkeypatch):
    vectors = np.random.default_rng(0).normal(size=(quality_model.BUCKETS, quality_model.DIMENSIONS)).astype(np.float32)
    texts = pa.array(["one two three", None, "", "long " * 5000 + "end!", "one two three"])
    whole = quality_model.features(texts, vectors)
    monkeypatch.setattr(quality_model, "CHUNK_BYTES", 10)
    assert np.allclose(whole, quality_model.features(texts, vectors), atol=1e-5)
    assert (whole[1] == 0).all() and (whole[2] == 0).all() and np.allclose(whole[0], whole[4])


def test_temperature_and_degenerate_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    network = quality_model.Network(x, y)
    assert network.temperature > 0 and np.mean((network.score(x) >= 0.5) == y) > 0.7
    assert quality_model.Network(x[:0], y[:0]).score(x)[0] == 0.5
    assert quality_model.Network(x, np.ones(400)).score(x)[0] == 1.0


def test_edge_cases(spark):
    rows = [(i, ("good words here " if i % 2 else "bad!! stuff!! ") * 5, "x") for i in range(60)] + [(None, "t", "x"), (100, None, "x"), (100, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int").withColumn("text", F.lit("no"))
    vectors, network = quality_model.train(docs, labels)
    found = quality_model.scores(docs, vectors, network).collect()
    assert len(found) == len(rows) and all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in found if r["doc_id"] is not None and r["doc_id"] < 60)
    kept = quality_model.kept(docs, vectors, network, 0.5)
    assert kept.columns == docs.columns and 29 <= kept.count() <= 33
    assert quality_model.scores(docs.limit(0), vectors, network).count() == 0
    empty = quality_model.train(docs.limit(0), labels.limit(0))[1]
    assert not empty.fitted
