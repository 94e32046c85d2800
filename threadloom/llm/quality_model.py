"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

A word counts as its letters and as its marks (punctuation kinds, all capitals, a repeat of
the word before); both are units, hashed into a fixed number of buckets. Every unit has a
sparse random index vector, and its word vector is the sum of the index vectors of the units
around it over the whole corpus. A document's features are the mean and spread of its units'
vectors; a two-layer numpy network with a fitted temperature turns them into a probability.

Two passes over the texts: one sums context vectors (each task yields at most ``BUCKETS``
rows, which Spark sums by bucket), one scores. The table of word vectors has a fixed size, so
it reaches the driver and the tasks whatever the corpus. The network is fitted on the driver
on at most ``MOST_LABELLED`` labelled documents, those with the smallest hashes of their ids.

Defined results: null and empty texts have no units and get the score of zero features;
without labels of both kinds the score is the share of label 1 (0.5 without any); an id with
several labels counts with each; null labels and ids are not learnt from; repeated rows each
get their row; an empty table gives an empty table; columns other than those named are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: The last buckets are for marks.
MARKS = 1 << 8
DIMENSIONS = 32
NONZERO = 2
WINDOW = 2
HIDDEN = 32
EPOCHS = 40
MOST_LABELLED = 20_000
#: Labelled rows kept apart to fit the temperature.
CALIBRATION_SHARE = 0.2
#: Words that a worker remembers the buckets of.
CACHE_ENTRIES = 250_000
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 400_000
REPEAT = BUCKETS - 1

_LETTERS = re.compile(r"[^\W_]+")


class _Units(dict):
    """A bounded cache from a word to the buckets of its letters and of its marks, as one number: each plus one (0: none), the marks' above the lowest 16 bits."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if word.isalnum():
            letters, marks = word, ""
        elif word[:-1].isalnum():  # a word and the mark after it
            letters, marks = word[:-1], word[-1]
        else:
            letters = "".join(_LETTERS.findall(word))
            marks = "".join(sorted(set(_LETTERS.sub("", word))))
        letters = letters.lower()
        if len(letters) > 1 and word.upper() == word and word.lower() != word:
            marks += "A"
        core = 1 + xxhash.xxh64_intdigest(letters) % (BUCKETS - MARKS) if letters else 0
        mark = 1 + BUCKETS - MARKS + xxhash.xxh64_intdigest(marks) % (MARKS - 1) if marks else 0
        self[word] = found = core | mark << 16
        return found


_units = _Units()


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts as (start, number, unit buckets, the text of each unit)."""
    texts = pc.fill_null(texts, "")
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = sizes[start - 1] if start else 0
        n = max(1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")) - start)
        words = pc.ascii_split_whitespace(texts.slice(start, n))
        many = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        table = np.fromiter(map(_units.__getitem__, known), np.int32, len(known))[index]
        owner = np.repeat(np.arange(n), many)
        again = np.zeros(len(index), bool)
        again[1:] = (index[1:] == index[:-1]) & (owner[1:] == owner[:-1])
        units = np.full((len(index), 3), -1, np.int32)
        units[:, 0] = (table & 0xFFFF) - 1
        units[:, 1] = (table >> 16) - 1
        units[again, 2] = REPEAT
        real = units >= 0
        yield start, n, units[real], np.repeat(owner, 3).reshape(-1, 3)[real]
        start += n


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of every bucket the places and signs of its index vector's non-zero components."""
    rng = np.random.default_rng(0)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = _index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS, np.int64)
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, units, owner in _chunks(batch.column(0)):
            counts += np.bincount(units, minlength=BUCKETS)
            for step in range(1, WINDOW + 1):
                near = owner[step:] == owner[:-step]
                left, right = units[:-step][near].astype(np.int64), units[step:][near].astype(np.int64)
                for own, other in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(own * DIMENSIONS + places[other, k], signs[other, k], len(total)).astype(np.int64)
    used = np.nonzero(counts)[0]
    columns = [pa.array(used), pa.array(counts[used]), pa.array(list(total.reshape(BUCKETS, DIMENSIONS)[used]), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "context"])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The word vectors of all buckets (rows of length one, or zero), from all rows of ``docs``."""
    parts = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(_sum_contexts, "bucket long, n long, context array<long>")
    sums = parts.groupBy("bucket").agg(*[F.sum(F.get("context", F.lit(k))).alias(f"c{k}") for k in range(DIMENSIONS)])
    rows = sums.toPandas()  # at most BUCKETS rows
    vectors = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    if len(rows):
        own = rows.drop(columns="bucket").to_numpy(np.float64)
        vectors[rows["bucket"].to_numpy()] = own / np.maximum(np.sqrt((own * own).sum(axis=1, keepdims=True)), 1e-9)
    return vectors


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """For each text mean and spread of its units' vectors and their number on a log scale."""
    found = np.zeros((len(texts), 2 * DIMENSIONS + 1), np.float64)
    for start, n, units, owner in _chunks(texts):
        many = np.bincount(owner, minlength=n)
        some = np.nonzero(many)[0]
        if not len(some):
            continue
        at = np.concatenate(([0], np.cumsum(many[some])[:-1]))
        own = vectors[units]
        mean = np.add.reduceat(own, at, axis=0, dtype=np.float64) / many[some, None]
        square = np.add.reduceat(own * own, at, axis=0, dtype=np.float64) / many[some, None]
        rows = start + some
        found[rows, :DIMENSIONS] = mean
        found[rows, DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        found[rows, -1] = np.log1p(many[some]) / 10
    return found


class Network:
    """Two layers, tanh between them; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.fitted = len(y) > 0 and 0 < self.prior < 1
        if self.fitted:
            self._fit(x, y)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(0)
        order = rng.permutation(len(y))
        held = order[: int(len(y) * CALIBRATION_SHARE)]
        learnt = order[len(held) :]
        self.mean, self.scale = x[learnt].mean(axis=0), x[learnt].std(axis=0) + 1e-6
        inputs = (x - self.mean) / self.scale
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
        self.layers = [rng.normal(0, 1 / np.sqrt(s[0]), s) if k % 2 == 0 else np.zeros(s) for k, s in enumerate(shapes)]
        moments = [(np.zeros(s), np.zeros(s)) for s in shapes]
        step = 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
            shuffled = rng.permutation(learnt)
            for at in range(0, len(shuffled), 128):
                rows = shuffled[at : at + 128]
                w1, b1, w2, _ = self.layers
                a, target = inputs[rows], y[rows]
                h = np.tanh(a @ w1 + b1)
                error = (self._sigmoid(h @ w2 + self.layers[3][0]) - target) / len(rows)
                back = error[:, None] * w2 * (1 - h * h)
                slopes = [a.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ error + 1e-4 * w2, np.array([error.sum()])]
                step += 1
                for k, slope in enumerate(slopes):
                    m, v = moments[k]
                    m += 0.1 * (slope - m)
                    v += 0.001 * (slope * slope - v)
                    self.layers[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logits = self._logits(x[held])
        if len(held) and 0 < y[held].mean() < 1:
            choices = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.logaddexp(0, np.where(y[held] == 1, -logits, logits) / t).mean() for t in choices]
            self.temperature = float(choices[int(np.argmin(loss))])

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._logits(x) / self.temperature) if self.fitted else np.full(len(x), self.prior)


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Network:
    """A network fitted on at most ``most`` rows of ``labels`` (``id_col``, ``label_col``) whose documents are given."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("double").alias("y")).where("id is not null and y is not null")
    known = known.orderBy(F.xxhash64("id"), "y").limit(most)  # so the broadcast has a bound
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(known), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(features(batch.column(0), vectors)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1), batch.column(2)], names=["x", "y", "at"])

    found = rows.select("text", "y", F.xxhash64("id", "text", "y").alias("at")).mapInArrow(run, "x array<double>, y double, at long")
    found = found.orderBy("at").limit(most).toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, 2 * DIMENSIONS + 1))
    return Network(x, (found["y"].to_numpy() > 0.5).astype(float))


def scores(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.score(features(batch.column(1), vectors)))], names=[id_col, "score"])

    rows = docs.select(docs[id_col], docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, score double")


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``labels`` that are not held out: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(~held_out(labels[id_col]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs`` and a network fitted on the labels that are not held out."""
    vectors = word_vectors(docs, text_col)
    return vectors, fit(docs, learnable(labels, id_col), vectors, id_col, text_col, label_col)


def kept(docs: DataFrame, vectors: np.ndarray, network: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score at least ``least``, in one pass without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(network.score(features(batch.column(at).cast(pa.string()), vectors)) >= least))

    return docs.mapInArrow(run, docs.schema)
