"""Source divergence audit: how far the sources of a language use words differently.

Texts become terms by one ``bytes.translate``, which lowers A-Z and blanks all other ASCII
that is no letter, and ``bytes.split``. A ``Counter`` for each document feeds counters for
each (language, source), which leave the task as rows of a sparse table whenever they hold
``HELD`` terms; Spark adds the rows up. Each language keeps the terms in enough of its
documents, and all shares are whole parts of ``SCALE`` with additive smoothing, computed in
exact decimals.

The distance of two sources is the sum over all kept terms of the difference of their
shares. A source that lacks a term has a share there that depends on the source alone, so
only terms that a source has are stored. The languages' terms and sources are dealt into
blocks; a task compares a block of at most about ``SOURCES`` sources with another over about
``TERMS`` terms as two dense arrays and returns a sum for each pair, so no pair is ever
written for a term. The work grows with the square of a language's number of sources, as
the rows that the audit returns do.

A hot source or word is only a larger number: texts stay where they are read, and counts are
combined in the task and on the map side before each shuffle.

Defined results: null and empty texts have no terms, null languages and sources are empty
strings; every (language, source) that occurs has its pairs, with value 0 where the language
keeps no term; rows of equal ids, or without one, are documents each; equal values are
ranked by item; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import staged

#: A term is kept if so many documents of the language hold it.
MIN_DOCS = 30
#: What is added to each count, and what a share of one is.
SMOOTHING = 5
SCALE = 1_000_000_000
#: How many of a source's own terms are returned.
TOP_TERMS = 50
#: Entries that a task's counters hold before they become rows.
HELD = 200_000
#: Sources and terms of a block.
SOURCES, TERMS = 256, 1024
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TABLE = bytes(x + 32 if 0x41 <= x <= 0x5A else x if x in _LETTERS else 0x20 for x in range(256))


def pieces(text: bytes) -> Iterator[bytes]:
    """A translated text in parts that end between terms."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(b" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def terms(text: bytes) -> Counter:
    """How often each term occurs in a UTF-8 text."""
    found: Counter = Counter()
    for part in pieces(text.translate(TABLE)):
        found.update(part.split())
    return found


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n_docs, n``: documents that hold a term, and how often it occurs; the empty term stands for the source itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            flat = [(lang, source, term, n_docs, often[term]) for (lang, source), (holding, often) in held.items() for term, n_docs in holding.items()]
            held.clear()
            columns = list(zip(*flat, strict=True))
            names = pa.array(columns[2], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), names, pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "source", "term", "n_docs", "n"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text in zip(zip(langs, sources, strict=True), batch.column(2), strict=True):
                holding, often = held.setdefault(key, (Counter(), Counter()))
                own = terms(text.as_py())
                before = len(holding)
                holding.update(own.keys())
                holding[b""] += 1
                often.update(own)
                size += len(holding) - before
                if size >= HELD:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    text = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n_docs long, n long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))


def share(n: Column, total: Column, kept: Column, smoothing: int = SMOOTHING) -> Column:
    """A count's smoothed share of all kept terms as a whole number; 0 where a language keeps none."""
    wide = lambda c: c.cast("decimal(20,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(n + smoothing)
    below = wide(total + smoothing * kept)
    return F.when(kept > 0, 1 + F.call_function("div", above, below)).otherwise(0).cast("long")


def _pair_sums(rows: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each two sources of a language their distance.

    ``rows`` holds ``lang, source, term, p, p0, kept`` with a null term for the source
    itself; ``p0`` is the source's share of a term that it lacks.
    """

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        lang, one, other, part = (x.as_py() for x in key)
        own, term, p = table["own"].to_numpy(), table["term"].combine_chunks(), table["p"].to_numpy()
        itself = np.asarray(term.is_null())
        source = table["source"].combine_chunks().dictionary_encode()
        names, number = source.dictionary, source.indices.to_numpy()
        place = term.dictionary_encode().indices.fill_null(0).to_numpy()
        width = int(place.max()) + 1 if (~itself).any() else 0
        kept = int(table["kept"][0].as_py()) if part == 0 else 0

        def dense(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Numbers of the block's sources, their shares where they lack a term, and their shares of each term."""
            at = itself & (own == block)
            who, base = number[at], p[at]
            line = np.full(len(names), -1)
            line[who] = np.arange(len(who))
            array = np.repeat(base[:, None], width, 1)
            cells = ~itself & (own == block)
            array[line[number[cells]], place[cells]] = p[cells]
            return who, base, array

        left = dense(one)
        right = left if one == other else dense(other)
        sums = np.zeros((len(left[0]), len(right[0])), np.int64)
        for i in range(len(sums)):
            sums[i] = np.abs(right[2] - left[2][i]).sum(1) + (kept - width) * np.abs(right[1] - left[1][i])
        a, b = np.repeat(left[0], len(right[0])), np.tile(right[0], len(left[0]))
        value = sums.ravel()
        if one == other:
            a, b, value = a[a != b], b[a != b], value[a != b]
        else:
            a, b, value = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((value, value))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": pa.array(value, pa.int64())})

    partners = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = rows.withColumn("k", F.explode(partners)).withColumns({"one": F.least("own", "k"), "other": F.greatest("own", "k")})
    sums = dealt.groupBy("lang", "one", "other", "part").applyInArrow(compare, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, top_terms: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: the distance to each other source of the language (``pair``), and the terms that the source prefers most (``term``)."""
    all_counts = staged(counts(docs, text_col, lang_col, source_col), "term-counts")
    real = all_counts.where("term <> ''")
    kept = real.groupBy("lang", "term").agg(F.sum("n_docs").alias("in_docs"), F.sum("n").alias("lang_n")).where(F.col("in_docs") >= min_docs)
    held = staged(real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    # One row for each language and each source.
    by_term = held.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    own = all_counts.where("term = ''").select("lang", "source")
    blocks = own.groupBy("lang").agg(F.count("*").alias("n_sources"))
    langs = blocks.join(langs, "lang", "left").fillna(0)
    langs = langs.withColumn("blocks", F.ceil(F.col("n_sources") / SOURCES).cast("int")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS)).cast("int"))
    totals = own.join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").fillna(0)
    groups = totals.join(langs, "lang").withColumn("own", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    groups = staged(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept"), smoothing)), "source-totals")

    shares = held.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"), smoothing))
    columns = ["lang", "source", "own", "blocks", "part", "term", "p", "kept"]
    cells = shares.withColumn("part", F.pmod(F.xxhash64("term"), "parts").cast("int")).select(columns)
    itself = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"term": F.lit(None).cast("string"), "p": F.col("p0")}).select(columns)
    pairs = _pair_sums(cells.unionByName(itself)).withColumn("part", F.lit("pair"))

    gain = F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), smoothing)
    preferred = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gain.alias("value")).where("value > 0")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best)
    top = preferred.withColumn("rank", rank).where(F.col("rank") <= top_terms)
    return pairs.withColumn("rank", rank).unionByName(top).select("lang", "source", "part", "item", "value", "rank")
