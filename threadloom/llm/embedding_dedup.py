"""Near-duplicate embeddings by cross-polytope hashing.

Equal vectors of a label are one class from then on, named by a 64-bit hash of both (among
10^9 different vectors any two share a name with a probability of 0.03). A class is hashed by fast Hadamard
rotations (three rounds of random signs and a Hadamard transform): in each rotation the
largest coordinate and its sign name a vertex of the cross-polytope, and three rotations
make a bucket. Multiprobe adds the buckets with the second-best vertex in one of the three.
Classes that share a bucket of any of the tables are candidates, and all candidates are
verified in double precision.

Only ids go through the grouping by bucket; vectors are joined to those that share a bucket
with another class. Buckets are dealt into blocks and blocks are paired, so no bucket is one
task's input, and each pair of blocks yields counts of links and the edges of a spanning
forest and not all links. A pair counts in the first bucket that it shares.

At the default tables and probes a pair with a cosine of just 0.98 in 64 dimensions shares a
bucket with probability 0.9998.

Defined results: null vectors, vectors that are empty, zero or hold nulls or non-finite
numbers, and vectors with a null label link with nothing; vectors of different lengths are
not linked; repeated rows are copies of each other; a null id counts as a link of others and
is ignored for the smallest id; an empty table gives an empty table; columns other than the
three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged
from threadloom.llm.components import components, spanning_edges

THRESHOLD = 0.98
TABLES = 4
ROTATIONS = 3
#: Classes of a bucket that are compared with as many others at once.
BLOCK = 512
SEED = 0


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of the last axis (a power of two), without scaling."""
    n, half = x.shape[-1], 1
    while half < n:
        y = x.reshape(*x.shape[:-1], n // (2 * half), 2, half)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        half *= 2
    return x


def unit(vectors: np.ndarray) -> np.ndarray:
    """Finite non-zero rows in double precision with length one."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def buckets(vectors: np.ndarray, tables: int = TABLES, rotations: int = ROTATIONS, seed: int = SEED) -> np.ndarray:
    """The bucket ids of unit vectors: a row of ``tables * (1 + rotations)`` for each vector."""
    n, d = vectors.shape
    width = 1 << max(0, d - 1).bit_length()
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, tables * rotations, width))
    found = np.empty((n, tables, 1 + rotations), np.int64)
    for at in range(0, n, 1024):
        part = np.zeros((len(vectors[at : at + 1024]), width))
        part[:, :d] = vectors[at : at + 1024]
        y = part[:, None, :]
        for k in range(3):
            y = _hadamard(y * signs[k])
        size = np.abs(y)
        first = size.argmax(axis=2)
        np.put_along_axis(size, first[..., None], -1.0, axis=2)
        second = size.argmax(axis=2)
        vertex = lambda i: 2 * i + (np.take_along_axis(y, i[..., None], 2)[..., 0] < 0)  # noqa: B023, E731
        best, next_best = (vertex(i).reshape(-1, tables, rotations) for i in (first, second))
        for probe in range(1 + rotations):
            code = np.broadcast_to(np.arange(tables), best.shape[:2]).astype(np.int64)
            for r in range(rotations):
                code = code * (2 * width) + (next_best if probe == r + 1 else best)[:, :, r]
            found[at : at + 1024, :, probe] = code
    return found.reshape(n, -1)


def _hash_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            vectors, keys = part.column(1).to_pylist(), part.column(0).to_numpy(zero_copy_only=False)
            lengths = np.array([len(v) for v in vectors])
            for n in np.unique(lengths):
                at_n = np.nonzero(lengths == n)[0]
                ids = buckets(unit(np.array([vectors[i] for i in at_n])))
                yield pa.RecordBatch.from_arrays([pa.array(keys[at_n]), pa.array(list(ids), pa.list_(pa.int64()))], names=["key", "buckets"])


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of frames that are sorted by ``by``, also where a group spans frames."""
    held: list[pd.DataFrame] = []
    name = None
    for frame in frames:
        for key, part in frame.groupby(by, sort=False):
            if key != name and held:
                yield pd.concat(held)
                held = []
            name = key
            held.append(part)
    if held:
        yield pd.concat(held)


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each pair of blocks: ``key, other, n`` the edges of a forest (other not null) and counts of links."""
    for group in _groups(frames, ["label", "size", "bucket", "p", "q"]):
        x = unit(np.stack(group["embedding"].to_numpy()))
        keys, copies, first = group["key"].to_numpy(), group["copies"].to_numpy(), group["side"].to_numpy() == 0
        same = group["p"].iat[0] == group["q"].iat[0]
        left = np.nonzero(first)[0]
        right = left if same else np.nonzero(~first)[0]
        if not len(left) or not len(right):
            continue
        i, j = np.nonzero(x[left] @ x[right].T >= THRESHOLD)
        i, j = left[i], right[j]
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        ids, bucket = buckets(x), group["bucket"].iat[0]
        counted = np.zeros(len(i), bool)
        for at in range(0, len(i), 4096):
            a, b = ids[i[at : at + 4096]], ids[j[at : at + 4096]]
            shared = (a[:, :, None] == b[:, None, :]).any(axis=2)
            counted[at : at + 4096] = np.where(shared, a, np.iinfo(np.int64).max).min(axis=1) == bucket
        i, j = i[counted], j[counted]
        if not len(i):
            continue
        links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        some = np.nonzero(links)[0]
        yield pd.DataFrame({"key": keys[some], "other": pd.array([None] * len(some), "Int64"), "n": links[some].astype(np.int64)})
        edges = spanning_edges(keys[i], keys[j])
        yield pd.DataFrame({"key": edges[:, 0], "other": pd.array(edges[:, 1], "Int64"), "n": 0})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``."""
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("embedding"), vectors[label_col].alias("label"))
    sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    key = F.when(F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)), F.xxhash64("label", "embedding"))
    rows = rows.withColumn("key", key)
    ids = rows.select("vec_id", "key")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    classes = staged(classes.withColumn("size", F.size("embedding")), "vector-classes")

    hashed = classes.select("key", "embedding").mapInArrow(_hash_classes, "key long, buckets array<long>")
    held = hashed.select("key", F.explode("buckets").alias("bucket")).join(classes.select("key", "label", "size"), "key")
    held = staged(held.distinct(), "vector-buckets")
    shared = held.groupBy("label", "size", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    found = held.join(shared, ["label", "size", "bucket"]).join(classes.select("key", "copies", "embedding"), "key")
    found = found.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    found = found.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(F.col("block"), k).alias("p"), F.greatest(F.col("block"), k).alias("q"), (k < F.col("block")).cast("int").alias("side")),
    )
    dealt = found.withColumn("x", F.explode(met)).select("label", "size", "bucket", "x.p", "x.q", "x.side", "key", "copies", "embedding")
    by = ["label", "size", "bucket", "p", "q"]
    links = staged(dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(_compare, "key long, other long, n long"), "vector-links")

    counts = links.where("other is null").groupBy("key").agg(F.sum("n").alias("n"))
    roots = components(links.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    marked = classes.select("key", "least", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    marked = marked.join(smallest, "root").join(counts, "key", "left")
    marked = marked.select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return ids.join(marked, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
