"""SimHash near-duplicates: fingerprints, linked fingerprints and connected components.

Fingerprints come from one pass over the texts without a shuffle. Equal fingerprints are one
class from then on. A fingerprint is mapped to the bit counts of its 32 two-bit segments,
kept in unary so that the Manhattan distance of two embeddings is the bit count of their
exclusive or. That distance is never above the Hamming distance, so links are found by a
grid range-join on it: of six groups of segments at least three are equal where the distance
is at most three, so linked fingerprints share the cell of one of the 20 choices of three
groups. Pairs in a cell are bounded by the Manhattan distance and then verified exactly.

The grid is dealt out once, as choice, cell and fingerprint; all else is computed from these.
No cell is ever one task's whole input: cells above ``FEW`` fingerprints are dealt into blocks
of ``BLOCK`` and blocks are paired, and each pair of blocks yields the edges of a spanning
forest and not all links. Components come from alternating large-star and small-star steps over
edges between distinct fingerprints, with each round's edges written to the shared folder.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
null ids are ignored for the smallest id of a component (its id is null if it has no other);
repeated rows each get their row; an empty table gives an empty table; columns other than
the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import staged
from threadloom.llm.components import components, spanning_edges
from threadloom.storage import released, unshuffled

SEED = 42
SHINGLE = 3
MAX_BITS = 3
GROUPS = 6
#: Up to so many fingerprints of a cell are compared by a join.
FEW = 48
#: Fingerprints of a cell that one task compares with as many others.
BLOCK = 1024
#: Words hashed at once in a long text.
CHUNK = 1 << 18
#: What ``representatives`` takes for similar, and the odd numbers by which it mixes hashes of words.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8
WORD_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Frequent shingles are told by about so many texts, of which they are in ``OFTEN`` or more, and at most ``MOST_OFTEN`` are known.
SAMPLE = 8192
OFTEN = 3
MOST_OFTEN = 100_000
#: Bits by which candidates are bounded before their sets are compared.
PARITIES = 1024
#: Up to so many candidates their ends are sent to the texts instead of the texts to them.
SENT = 100_000


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; zero without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    size = min(size, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined = b" ".join(tokens)
    n = len(tokens) - size + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        pieces = [joined[a:b] for a, b in zip(starts[at : min(n, at + CHUNK)].tolist(), ends[size - 1 :][at : at + CHUNK].tolist(), strict=False)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), ">u8", len(pieces))
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def word_fingerprints(text: str | None) -> list[int]:
    """The SimHashes of a text's distinct words under ``WORD_SEEDS``, unsigned; zeros without words."""
    words = set((text or "").encode().lower().split())
    if not words:
        return [0] * len(WORD_SEEDS)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    found = []
    for seed in WORD_SEEDS:
        mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(seed)
        mixed = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(seed)).astype(">u8")
        counts = np.unpackbits(mixed.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        found.append(int.from_bytes(np.packbits(2 * counts > len(words)).tobytes(), "big"))
    return found


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``size`` words (of the whole sequence, if it is shorter), sorted."""
    tokens = (text or "").encode().lower().split()
    size = min(size, len(tokens))
    pieces = {b" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if tokens else set()
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces)))


def rarest(hashes: np.ndarray, least: float, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rarest of a text's shingles, of which two texts with a similarity of ``least`` share one, whatever is in ``often``.

    Such texts share ``least`` times the larger one's number of shingles. So, in any order that
    all texts have in common, their first shingles meet if only less than this number is left
    out. The order is by hash, with those of ``often`` (sorted) at the end by their ``rank``.
    """
    if not len(hashes):
        return hashes
    n = len(hashes) - math.ceil(least * len(hashes) - 1e-6) + 1
    if not len(often):
        return hashes[:n]
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    known = often[at] == hashes
    rare = hashes[~known]
    if len(rare) < n:
        rare = np.concatenate([rare, often[at[known][np.argsort(rank[at[known]])]]])
    return rare[:n]


def parities(hashes: np.ndarray, buckets: int = PARITIES) -> np.ndarray:
    """Of each of ``buckets`` of a text's shingles whether it holds an odd number, as longs: two texts' differing shingles are at least their differing bits."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_parities(hashes: np.ndarray) -> np.ndarray | None:
    """The ``parities`` of a text of more than ``PARITIES`` shingles, in a power of two of buckets that is no less than these."""
    return parities(hashes, 1 << (len(hashes) - 1).bit_length()) if len(hashes) > PARITIES else None


def _differing(x: Column, y: Column) -> Column:
    """Differing bits of two texts' ``parities``; the larger of them is folded to the buckets of the other."""
    least = F.least(F.size(x), F.size(y))

    def folded(odd: Column) -> Column:
        parts = F.sequence(F.lit(0), (F.size(odd) / least).cast("int") - 1)
        return F.transform(F.sequence(F.lit(0), least - 1), lambda i: F.aggregate(parts, F.lit(0).cast("long"), lambda all, k: all.bitwiseXOR(F.get(odd, k * least + i))))

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda all, one: all + one)


def _often(docs: DataFrame, text: Column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, sorted, and their rank by frequency. They only spare work: ``rarest`` is right with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in batch.column(0).slice(at, 64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["h"])

    share = max(1, docs.count() // SAMPLE)
    picked = docs.select(text.cast("string").alias("__text")).where(F.pmod(F.xxhash64("__text"), F.lit(share)) == 0).distinct()
    found = picked.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    with unshuffled(docs.sparkSession):
        top = found.orderBy(F.desc("n"), "h").limit(MOST_OFTEN).collect()
    found = np.array([r["h"] for r in reversed(top)], np.int64).view(np.uint64)
    rank = np.argsort(found)
    return found[rank], rank


def _embedded(fp: Column) -> Column:
    """Bit counts of the two-bit segments in unary: 0 as 00, 1 as 01, 2 as 11."""
    low = F.lit(0x5555555555555555)
    next_bit = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(next_bit).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choices(groups: int = GROUPS, differing: int = MAX_BITS) -> list[tuple[int, list[int | None]]]:
    """For each choice of groups that may be the equal ones: the bits of their segments, and
    of each lower group outside the choice. Where none of those is equal too, the choice is
    a pair's first, so that a pair counts in one of the cells it shares."""
    own = [0] * groups
    for segment in range(32):
        own[segment % groups] |= 3 << (2 * segment)
    found = []
    for choice in combinations(range(groups), groups - differing):
        lower = [_signed(own[g]) for g in range(max(choice)) if g not in choice]
        found.append((_signed(sum(own[g] for g in choice)), lower + [None] * (differing - len(lower))))
    return found


def _linked(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs within ``most`` bits: Manhattan bound first, then the exact distance."""
    low = np.uint64(0x5555555555555555)
    one = np.uint64(1)

    def unary(x: np.ndarray) -> np.ndarray:
        return ((x | (x >> one)) & low) | ((x & (x >> one) & low) << one)

    near = np.bitwise_count(unary(left)[:, None] ^ unary(right)[None, :]) <= most
    i, j = np.nonzero(near)
    exact = np.bitwise_count(left[i] ^ right[j]) <= most
    return i[exact], j[exact]


def _block_edges(pairs: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges among the linked fingerprints of one pair of blocks (or of one block)."""
    fps = pairs["fp"].to_numpy().view(np.uint64)
    first = pairs["side"].to_numpy() == 0
    left, right = fps[first], fps[~first]
    same = not len(right)
    right = left if same else right
    found: list[np.ndarray] = []
    for at in range(0, len(left), BLOCK):
        i, j = _linked(left[at : at + BLOCK], right, MAX_BITS)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        found.append(spanning_edges(left[i].view(np.int64), right[j].view(np.int64)))
    edges = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"choice": np.full(len(edges), pairs["choice"].iloc[0], np.int32), "a": edges[:, 0], "b": edges[:, 1]})


def _grid(fps: DataFrame) -> DataFrame:
    """Each fingerprint of each ``table`` in its cell of every choice of groups: ``choice, cell, fp``; dealt out by cell."""
    choices = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("mask")) for i, (m, _) in enumerate(_choices())])
    rows = fps.select("fp", _embedded(F.col("fp")).alias("e"), (F.col("table") * len(_choices())).alias("from"), F.explode(choices).alias("c"))
    cells = rows.select((F.col("from") + F.col("c.i")).cast("int").alias("choice"), F.col("e").bitwiseAND(F.col("c.mask")).alias("cell"), "fp")
    # None is null; said here, no reader adds a filter of its own below the exchange, and all of them share it.
    return cells.where("choice is not null and cell is not null and fp is not null").repartition("choice", "cell")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(table, a, b)`` between distinct fingerprints ``table, fp`` that join exactly the fingerprints linked by chains of links, each table for itself."""
    cells = _grid(fps)
    # The extremes keep all columns, so that counting and joining read the same exchange.
    sizes = cells.groupBy("choice", "cell").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("choice", "cell", "n")
    few, large = sizes.where(F.col("n") <= FEW).select("choice", "cell"), sizes.where(F.col("n") > FEW)

    left, right = cells.join(few, ["choice", "cell"], "left_semi").alias("a"), cells.alias("b")
    apart = _embedded(F.col("a.fp")).bitwiseXOR(_embedded(F.col("b.fp")))
    near = F.bit_count(apart) <= MAX_BITS  # the Manhattan distance of the counts
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS
    masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in low]) for _, low in _choices()])
    lower = F.element_at(masks, F.col("a.choice") % len(_choices()) + 1)
    first = F.forall(lower, lambda mask: mask.isNull() | (apart.bitwiseAND(mask) != 0))
    same_cell = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = left.join(right, same_cell & near & exact & first).select(F.col("a.choice").alias("choice"), F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    # A block of a large cell meets itself and each later one.
    rows = cells.join(large, ["choice", "cell"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(F.col("block"), k).alias("p"), F.greatest(F.col("block"), k).alias("q"), (k < F.col("block")).cast("int").alias("side")),
    )
    dealt = rows.select("fp", "choice", "cell", F.explode(met).alias("x")).select("fp", "choice", "cell", "x.p", "x.q", "x.side")
    forests = dealt.groupBy("choice", "cell", "p", "q").applyInPandas(_block_edges, "choice int, a long, b long")
    table = F.floor(F.col("choice") / len(_choices())).cast("int")
    return pairs.unionByName(forests).select(table.alias("table"), "a", "b").distinct()


def _rooted(classes: DataFrame) -> DataFrame:
    """``classes``, a row for each ``fp``, with the root of its component."""
    edges = staged(links(classes.select(F.lit(0).alias("table"), "fp")).select("a", "b"), "fingerprint-links")
    roots = components(edges)
    return classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links of at most three bits, for each row."""
    rows = staged(fingerprints(docs, id_col, text_col), "fingerprints")
    labelled = _rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = labelled.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def _text_key(text: Column) -> Column:
    """Names a text by 128 bits; texts without words are one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text.cast("binary")))).otherwise(F.lit(bytearray()))


def _id_key(doc_id: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), doc_id.isNull())


def _word_edges(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of text keys whose fingerprints of words are linked, enough of them to join all such texts."""
    own = classes.select("key", F.posexplode("fps").alias("table", "fp"))
    first = staged(own.groupBy("table", "fp").agg(F.min("key").alias("first")), "fingerprint-texts")
    same = own.join(first, ["table", "fp"]).where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    apart = links(first.select("table", "fp")).join(first.select("table", F.col("fp").alias("a"), F.col("first").alias("x")), ["table", "a"])
    apart = apart.join(first.select("table", F.col("fp").alias("b"), F.col("first").alias("y")), ["table", "b"])
    return same.unionByName(apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _similar(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The edges between texts whose shingle sets have a Jaccard similarity of at least ``least``."""
    both = edges.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
    near = (F.least(F.size("x"), F.size("y")) >= least * F.greatest(F.size("x"), F.size("y"))) & (F.size("y") > 0)
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(near).where(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _together(rare: DataFrame) -> DataFrame:
    """``h, x`` of the shingles that stand among the rarest of several texts; ``rare``: ``x`` names a text, ``rare`` are its shingles."""
    rows = rare.select(F.explode("rare").alias("h"), "x").repartition("h")
    shared = rows.groupBy("h").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low < high").select("h")
    return staged(rows.join(shared, "h"), "shared-shingles")


def _apart(together: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs ``(a, b)`` of text keys that share a rare shingle, are of like size and not joined yet; ``texts``: ``x, key, size, root``."""
    rows = together.join(texts, "x").select("h", "key", "size", "root")
    sizes = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    rows = rows.join(sizes.select("h", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "h")
    # A frequent shingle's texts are dealt into blocks, each of which meets all of them.
    left = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).alias("l")
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("r")
    like = F.least("l.size", "r.size") >= least * F.greatest("l.size", "r.size")
    met = (F.col("l.h") == F.col("r.h")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.key") < F.col("r.key")) & (F.col("l.root") != F.col("r.root")) & like
    return left.join(right, met).select(F.col("l.key").alias("a"), F.col("r.key").alias("b")).distinct()


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, all columns: one with the group's smallest id.

    Texts are similar if their sets of ``shingle``-word shingles have a Jaccard similarity of at
    least ``similarity``. First candidates are texts whose SimHashes of distinct words (which
    edits move less than those of shingles) are linked under one of ``WORD_SEEDS``, and for each
    rare shingle (``rarest``) its texts with the first of them. What these leave apart is met by
    all pairs that share a rare shingle, as all similar texts do; so no similar pair is left out.
    Each candidate is verified on the whole texts' sets of shingle hashes. A group is known by its texts and not by an id, so
    groups that share an id, or have only null ids, each keep one row. Of rows with equal ids in
    a group one stays. Texts without words are one group.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([word_fingerprints(x.as_py()) for x in part.column(2)], np.uint64).reshape(-1, len(WORD_SEEDS)).view(np.int64)
                sets = [shingle_hashes(x.as_py(), shingle) for x in part.column(2)]
                rare = pa.array([rarest(x, similarity, often, rank).view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(list(found), pa.list_(pa.int64())), pa.array(map(len, sets), pa.int32()), rare, pa.array([parities(x) for x in sets], pa.list_(pa.int64())), pa.array([wide_parities(x) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "key", "fps", "size", "rare", "odd", "wide"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "hashes"])

    text, doc_id = docs[text_col], docs[id_col]
    often, rank = _often(docs, text, shingle)
    narrow = docs.select(doc_id.alias("doc_id"), _text_key(text).alias("key"), text.cast("string").alias("__text"))
    rows = narrow.mapInArrow(prints, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, key binary, fps array<long>, size int, rare array<long>, odd array<long>, wide array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")

    def similar(candidates: DataFrame, classes: DataFrame) -> DataFrame:
        bound = (F.col("m") + F.col("n")) * (1 - similarity) / (1 + similarity) + 1e-6  # what similar sets of these sizes differ by at most

        def sided(edges: DataFrame, *columns: str) -> DataFrame:
            """``edges`` with columns of both their texts."""
            for end, names in (("a", ("m", "x")), ("b", ("n", "y"))):
                edges = edges.join(classes.select(F.col("key").alias(end), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)]), end)
            return edges

        near = sided(candidates, "size", "odd").where(F.least("m", "n") >= similarity * F.greatest("m", "n"))
        edges = staged(near.where(_differing(F.col("x"), F.col("y")) <= bound).select("a", "b"), "text-candidates")
        # Long texts fill the common buckets, so more of them tell which of these pairs need their sets.
        known = F.col("x").isNull() | F.col("y").isNull()
        edges = staged(sided(edges, "size", "wide").where(known | (_differing(F.col("x"), F.col("y")) <= bound)).select("a", "b"), "text-links")
        # One row of each text that has a link; by id and text, so copies are spread.
        ends = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        wanted = ends.join(classes, "key").select("key", _id_key(F.col("first.doc_id")).alias("id_key"))
        if edges.count() <= SENT:
            wanted = F.broadcast(wanted)
        held = docs.select(_text_key(text).alias("key"), _id_key(doc_id).alias("id_key"), text.cast("string").alias("__text"))
        texts = held.join(wanted, ["key", "id_key"]).groupBy("key", "id_key").agg(F.first("__text").alias("__text"))
        # The sets are the largest table here and are needed for this one step.
        with released(docs.sparkSession):
            sets = staged(texts.select("key", "__text").mapInArrow(shingled, "key binary, hashes array<long>"), "shingle-sets")
            return staged(_similar(edges, sets, similarity), "similar-texts", outlives=2)

    def rooted(edges: DataFrame, classes: DataFrame) -> DataFrame:
        roots = components(edges)
        return classes.select("key", "first", "size").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))

    # What is staged here is needed for the rows that stay, and deleted before these are fetched.
    with released(docs.sparkSession):
        classes = staged(rows.groupBy("key").agg(F.min(first).alias("first"), *[F.first(c).alias(c) for c in ("fps", "size", "rare", "odd", "wide")]), "texts")
        # Rows of shingles carry 64 bits of a text's name; texts that share these are all taken.
        named = classes.select(F.xxhash64("key").alias("x"), "key", "size")
        together = _together(classes.select(F.xxhash64("key").alias("x"), "rare"))
        stars = together.join(together.groupBy("h").agg(F.min("x").alias("y")), "h").where("x <> y").select("x", "y").distinct()
        stars = stars.join(named, "x").join(named.select(F.col("x").alias("y"), F.col("key").alias("other"), F.col("size").alias("of")), "y")
        stars = stars.where(F.least("size", "of") >= similarity * F.greatest("size", "of")).select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))
        found = similar(_word_edges(classes).unionByName(stars).distinct(), classes)
        rest = _apart(together, rooted(found, classes).select(F.xxhash64("key").alias("x"), "key", "size", "root"), similarity)
        labelled = rooted(found.unionByName(similar(rest, classes)), classes)
        kept = labelled.groupBy("root").agg(F.min(F.struct("first", "key")).alias("x")).select(F.col("x.key").alias("__key"), _id_key(F.col("x.first.doc_id")).alias("__id"))
        kept = staged(kept, "kept-texts", outlives=1)
    whole = docs.select(F.struct("*").alias("row"), _text_key(text).alias("__key"), _id_key(doc_id).alias("__id"))
    # An id with one text is few rows, so this only drops repeats; it needs no further shuffle.
    found = whole.join(kept, ["__key", "__id"], "left_semi").groupBy("__key", "__id").agg(F.any_value("row").alias("row"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
