"""Full-text search: postings, BM25, heuristic boosts, top hits and merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import ascii_lower, contains_all, contains_phrase, query_tokens, tokens

# Fixed values of the ranking function.
K1, B = 1.2, 0.75
TITLE_WEIGHT, TEXT_WEIGHT = 8.0, 1.0
LEAST_IDF = 1e-6
PHRASE_BOOST, ACTION_BOOST, HEADLINE_BOOST = 1000.0, 200.0, 100.0
LIMIT = 50


def postings(docs: DataFrame, fold=lambda text: text) -> DataFrame:
    """``token, doc_id, title_tf, text_tf`` of ``doc_id, title, text``; map-side sums before the shuffle."""
    parts = docs.select("doc_id", F.explode(tokens(fold(F.col("title")))).alias("token"), F.lit(1).alias("title_tf"), F.lit(0).alias("text_tf")).unionByName(
        docs.select("doc_id", F.explode(tokens(fold(F.col("text")))).alias("token"), F.lit(0).alias("title_tf"), F.lit(1).alias("text_tf"))
    )
    return parts.groupBy("token", "doc_id").agg(F.sum("title_tf").alias("title_tf"), F.sum("text_tf").alias("text_tf"))


def lengths(docs: DataFrame, fold=lambda text: text) -> DataFrame:
    """``doc_id, n_tokens`` of each document, title and text together."""
    return docs.select("doc_id", (F.size(tokens(fold(F.col("title")))) + F.size(tokens(fold(F.col("text"))))).cast("long").alias("n_tokens"))


def matches(posted: DataFrame, query: list[str]) -> DataFrame:
    """Documents that hold all of the query's tokens: ``doc_id, n_matched``."""
    wanted = sorted(set(query))
    found = posted.where(F.col("token").isin(wanted)).groupBy("doc_id").agg(F.count_distinct("token").alias("n_matched"))
    return found.where(F.col("n_matched") == len(wanted))


def corpus(sizes: DataFrame) -> DataFrame:
    """One row: ``n_docs, mean_tokens``."""
    return sizes.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("mean_tokens"))


def bm25(posted: DataFrame, sizes: DataFrame, query: list[str], known: tuple[int, float] | None = None) -> DataFrame:
    """``doc_id, bm25`` (lower is better) of the documents that hold all tokens; a repeated token counts again.

    Only the postings of the query's tokens are read. Document frequencies and the mean
    length are one row for each token and one row, so those joins are broadcast. Where the
    corpus' numbers are ``known``, lengths are read for documents with such tokens only.
    """
    wanted = sorted(set(query))
    if not wanted:
        return sizes.select("doc_id", F.lit(0.0).alias("bm25")).where("false")
    times = F.create_map(*[F.lit(x) for t in wanted for x in (t, query.count(t))])
    own = posted.where(F.col("token").isin(wanted))
    frequencies = own.groupBy("token").agg(F.count("*").alias("df"))
    rows = own.join(F.broadcast(frequencies), "token").join(sizes, "doc_id")
    if known is None:
        rows = rows.join(F.broadcast(corpus(sizes)))
    else:
        rows = rows.withColumns({"n_docs": F.lit(known[0]), "mean_tokens": F.lit(float(known[1]))})
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    tf = TITLE_WEIGHT * F.col("title_tf") + TEXT_WEIGHT * F.col("text_tf")
    norm = K1 * (1 - B + B * F.col("n_tokens") / F.col("mean_tokens"))
    part = idf * tf * (K1 + 1) / (tf + norm) * times[F.col("token")]
    scored = rows.groupBy("doc_id").agg(F.count("*").alias("n"), (-F.sum(part)).alias("bm25"))
    return scored.where(F.col("n") == len(wanted)).select("doc_id", "bm25")


def kind_boost(kind: Column) -> Column:
    return F.when(kind.isin("command_execution", "file_change"), ACTION_BOOST).when(kind.isin("thread_name", "thread_preview"), HEADLINE_BOOST).otherwise(0.0)


def heuristic(query: str, title: Column, text: Column, kind: Column) -> Column:
    """Points for the whole query as part of title or text (A-Z in either case alike), and for the kind."""
    phrase = F.lit(query.strip().lower())
    held = F.contains(ascii_lower(F.coalesce(title, F.lit(""))), phrase) | F.contains(ascii_lower(text), phrase)
    return F.when(held, PHRASE_BOOST).otherwise(0.0) + kind_boost(kind)


def rank(docs: DataFrame, scored: DataFrame, query: str) -> DataFrame:
    """``docs`` joined with their ``bm25``, with ``heuristic`` and ``score``."""
    rows = docs.join(scored, "doc_id").withColumn("heuristic", heuristic(query, F.col("title"), F.col("text"), F.col("kind")))
    return rows.withColumn("score", F.col("heuristic") - F.col("bm25"))


def top(ranked: DataFrame, limit: int = LIMIT, newest: list[Column] | None = None) -> DataFrame:
    """The best hits: heuristic, then BM25, then newest, then document order."""
    return ranked.orderBy(F.desc("heuristic"), F.round("bm25", 9), *(newest or []), "doc_id").limit(limit)


def overlay(docs: DataFrame, query: str) -> DataFrame:
    """Hits among documents that no index holds: all tokens must occur; points for the phrase, the kind and each token."""
    wanted = query_tokens(query)
    joined = tokens(F.concat_ws("\n", F.coalesce("title", F.lit("")), "text"))
    rows = docs.withColumn("__tokens", joined).where(contains_all(F.col("__tokens"), wanted))
    phrase = F.when(contains_phrase(F.col("__tokens"), wanted), PHRASE_BOOST).otherwise(0.0)
    return rows.withColumn("score", phrase + kind_boost(F.col("kind")) + float(len(wanted))).drop("__tokens")


def merge_hits(first: DataFrame, second: DataFrame, by: list[str], limit: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Both sets of hits, the best of those equal in ``by`` (``first`` before ``second``), in one order."""
    both = first.withColumn("__from", F.lit(0)).unionByName(second.withColumn("__from", F.lit(1)))
    best = Window.partitionBy(*by).orderBy("__from", F.desc("score"), *by)
    kept = both.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__from")
    if limit is None:
        return kept
    return kept.orderBy(F.desc("score"), *(order or []), *by).limit(limit)
