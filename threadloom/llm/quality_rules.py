"""Quality rules: base rules of each text, and the frequency of lines across documents.

Base figures come from array functions within a row, without a shuffle. For the method's
verdict, normalised lines are hashed and the documents of each host that hold a line are
counted. For a document its own exact copies count as itself and all others each: a document
is no evidence against its copies, which are for a near-duplicate stage. A line in more
documents than the limit for the size of its host is removed, and a document that keeps too
few of its words is rejected. A document is a row.

Everything is DataFrame functions. Texts are read once; a narrow table of figures and line
hashes is written to the shared folder and all later steps read that. Counts combine on the
map side and the first is by (host, line, text), so a very frequent line, host or text is
spread; the join with frequent lines is a plain inner join that Spark can split on skew.
Lines, hosts and windows are compared by 64-bit hashes, texts by 128-bit ones.

Defined results: a null text has no words and fails the base rules; null hosts form a host
of their own; repeated rows each get their row; an empty table gives an empty table; columns
other than the three named are not read, so no names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACE, let, staged

#: Base rules: fewer words, or a larger share of words in repeated windows, fails.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is above the limit if more documents of its host hold it than this number, and than
#: this power of the host's number of documents: the share that is allowed falls as hosts grow.
MAX_LINE_DOCS = 5
MAX_LINE_POWER = 0.5
#: A document that keeps a smaller share of its words is depleted.
MIN_LEFT_SHARE = 0.8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text holds twice or more.

    Windows are hashed and sorted by hash and position, so equal windows become neighbours;
    the words covered by their positions are then added up, at most three for each.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    def repeated(order: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(order, lambda x, j: same(x, F.get(order, j + 1)) | ((j > 0) & same(x, F.get(order, F.greatest(j - 1, F.lit(0))))))
        return let(F.sort_array(F.transform(hit, lambda x: x["p"])), covered)

    def counted(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(order, repeated))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, let(windows, counted)).otherwise(F.lit(0).cast("long"))


def _figures(w: Column) -> Column:
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words"),
    )


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case with its white space made single spaces."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def keys(host: Column, text: Column) -> list[Column]:
    """What decides a verdict: the host and the text, as short values."""
    return [F.xxhash64(F.coalesce(F.concat(F.lit("="), host), F.lit(""))).alias("host_key"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("text_key")]


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each row, in one pass without a shuffle: keys, base figures, and ``lines`` with hash and number of words."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"), docs[host_col].cast("string").alias("__host"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        rows.select(
            "doc_id",
            *keys(F.col("__host"), F.col("__text")),
            let(_words(text), _figures).alias("f"),
            (F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                F.transform(x, lambda y: F.struct(line_hash(y).alias("h"), F.size(F.split(F.trim(F.regexp_replace(y, SPACE, " ")), " ")).alias("n"))).alias("lines"),
            )).alias("g"),
        )
        .select("doc_id", "host_key", "text_key", "f.n_words", "f.word_chars", "n_symbols", "g.n_dup_lines", "f.n_repeat_words", "g.lines")
    )


def removals(rows: DataFrame, max_line_docs: int = MAX_LINE_DOCS, max_line_power: float = MAX_LINE_POWER) -> DataFrame:
    """From ``figures``: for each (host, text) that has lines above the limit their hashes and the number of words in them."""
    texts = rows.groupBy("host_key", "text_key").agg(F.count("*").alias("copies"), F.first("lines").alias("lines"))
    lines = texts.select("host_key", "text_key", "copies", F.explode("lines").alias("x")).select("host_key", "text_key", "copies", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    lines = lines.groupBy("host_key", "h", "text_key").agg(F.sum("n").alias("n"), F.first("copies").alias("copies"))
    hosts = rows.groupBy("host_key").agg(F.greatest(F.lit(float(max_line_docs)), F.pow(F.count("*").cast("double"), F.lit(max_line_power))).alias("most"))
    counts = lines.groupBy("host_key", "h").agg(F.sum("copies").alias("line_docs")).where(F.col("line_docs") > max_line_docs)
    above = counts.join(hosts, "host_key").where(F.col("line_docs") > F.col("most"))
    gone = lines.join(above, ["host_key", "h"]).where(F.col("line_docs") - F.col("copies") + 1 > F.col("most"))
    return gone.groupBy("host_key", "text_key").agg(F.sum("n").alias("removed_words"), F.collect_list("h").alias("removed"))


def verdicts(rows: DataFrame, removed: DataFrame, min_left_share: float = MIN_LEFT_SHARE) -> DataFrame:
    """``rows`` of ``figures`` with ``base_failed``, ``removed_words``, ``removed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0).cast("long"))
    return (
        rows.drop("lines")
        .join(removed, ["host_key", "text_key"], "left")
        .withColumn("removed_words", gone)
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("n_words") - gone >= min_left_share * F.col("n_words")))
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A verdict for each row of ``docs``: base figures, ``base_failed``, ``removed_words`` and ``kept``."""
    rows = staged(figures(docs, id_col, text_col, host_col), "quality-figures")
    return verdicts(rows, removals(rows))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, with the lines above the limits removed from the texts."""
    rows = staged(figures(docs, id_col, text_col, host_col), "quality-figures")
    by_text = verdicts(rows, removals(rows)).where("kept").groupBy("host_key", "text_key").agg(F.first("removed").alias("removed"))
    host_key, text_key = keys(F.col(host_col).cast("string"), F.col(text_col).cast("string"))
    named = docs.select(F.struct("*").alias("row"), host_key, text_key)
    kept = named.join(by_text, ["host_key", "text_key"])
    text = F.col("row").getField(text_col)
    left = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("removed"), line_hash(x)))
    new = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(left, "\n"))
    return kept.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
