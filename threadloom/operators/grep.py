"""Literal and regular-expression search over texts, and hits grouped by thread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import compact_line, compact_preview, has_text, kind_label, markdown_cell, regex_count, term_count
from threadloom.operators.pattern import java_pattern
from threadloom.operators.scope import in_scope


def grep(texts: DataFrame, pattern: str, regex: bool = False, thinking: bool = False, tools: bool = False) -> DataFrame:
    """Rows in scope whose ``text`` holds the pattern (case matters), with ``occurrences``; an empty literal matches all.

    Occurrences of a literal are those of its words, wherever they stand.
    """
    text = F.col("text")
    rows = texts.where(in_scope(F.col("kind"), thinking, tools) & text.isNotNull())
    if regex:
        own = java_pattern(pattern)
        return rows.where(F.regexp_like(text, F.lit(own))).withColumn("occurrences", regex_count(text, own))
    found = rows.where(F.contains(text, F.lit(pattern)))
    return found.withColumn("occurrences", term_count(text, pattern))


def grouped(hits: DataFrame, order: list[str]) -> DataFrame:
    """Hits by thread: ``thread_id, hits, occurrences, kinds`` (an array, as they first appear)``, first_text, at`` (the first place).

    Sums and the smallest row combine before the shuffle; the kinds are a set, put in order
    by the first place of each.
    """
    place = F.struct(*order)
    by_kind = hits.groupBy("thread_id", "kind").agg(F.count("*").alias("hits"), F.sum("occurrences").alias("occurrences"), F.min(place).alias("at"), F.min_by("text", place).alias("text"))
    return by_kind.groupBy("thread_id").agg(
        F.sum("hits").alias("hits"),
        F.sum("occurrences").alias("occurrences"),
        F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda x: x["kind"]).alias("kinds"),
        F.min_by("text", "at").alias("first_text"),
        F.min("at").alias("at"),
    )


def hit_rows(hits: DataFrame, order: list[str]) -> DataFrame:
    """Hits numbered within their thread (``ordinal``), with ``hit_id``."""
    ordinal = F.row_number().over(Window.partitionBy("thread_id").orderBy(*order))
    rows = hits.withColumn("ordinal", ordinal.cast("long"))
    return rows.withColumn("hit_id", F.concat_ws(":", "thread_id", F.coalesce("turn_id", F.lit("-")), "kind", F.col("ordinal").cast("string")))


def _given(column: str) -> Column:
    """A text, null where it is blank."""
    return F.when(has_text(F.col(column)), F.col(column))


def table_rows(hits: DataFrame, threads: DataFrame) -> DataFrame:
    """Hits with the ``line`` of a compact markdown table, with their thread's name or preview and folder."""
    name = F.coalesce(_given("name"), _given("preview"))
    info = threads.select("thread_id", name.alias("__name"), F.col("cwd").alias("__cwd"))
    cells = [kind_label(F.col("kind")), F.col("thread_id"), F.coalesce("__name", F.lit("(unnamed)")), F.coalesce("__cwd", F.lit("-")), F.col("text")]
    line = F.concat_ws(" | ", *[markdown_cell(compact_line(x)) for x in cells])
    return hits.join(info, "thread_id", "left").withColumn("line", F.concat(F.lit("| "), line, F.lit(" |"))).drop("__name", "__cwd")


def shown_lines(hits: DataFrame, threads: DataFrame, order: list[str], by_place: bool, scored: bool) -> DataFrame:
    """The lines of a grouped view of hits, in order of ``key, thread_id, n``: a head for each thread, then its hits.

    A head has the thread's name, or else how its first prompt begins, and its folder. Threads are in order of their first place or of their ids. ``{n}`` in a head stands for
    the thread's number.
    """
    named = F.coalesce(F.concat(F.lit("\n   name: "), _given("name")), F.concat(F.lit("\n   first prompt: "), compact_preview(_given("preview"))), F.lit(""))
    about = threads.select("thread_id", F.concat(named, F.coalesce(F.concat(F.lit("\n   cwd: "), "cwd"), F.lit(""))).alias("about"))
    groups = grouped(hits, order).join(about, "thread_id", "left")
    key = (lambda c: F.col(c)) if by_place else (lambda c: F.lit(0))
    label = lambda ks: F.array_join(F.array_distinct(F.transform(ks, kind_label)), ", ")
    head = F.concat(F.lit("{n}. thread_id: "), "thread_id", F.coalesce("about", F.lit("")), F.lit("\n   hits: "), F.col("hits").cast("string"), F.lit("\n   occurrences: "), F.col("occurrences").cast("string"), F.lit("\n   matched in: "), label(F.col("kinds")))
    if scored:
        groups = groups.join(hits.groupBy("thread_id").agg(F.max("score").alias("best")), "thread_id")
        head = F.concat(head, F.lit("\n   best score: "), F.format_string("%.2f", "best"))
    rows = hit_rows(hits, order)
    if by_place:
        rows = rows.join(groups.select("thread_id", "at"), "thread_id")
    body = F.concat(F.lit("\n   "), kind_label(F.col("kind")), F.lit(" | turn: "), F.coalesce("turn_id", F.lit("-")), F.lit(" | hit_id: "), "hit_id", F.lit("\n     "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n     ")))
    lines = groups.select(key("at").alias("key"), "thread_id", F.lit(0).cast("long").alias("n"), head.alias("line"))
    lines = lines.unionByName(rows.select(key("at").alias("key"), "thread_id", F.col("ordinal").alias("n"), body.alias("line")))
    return lines.orderBy("key", "thread_id", "n")
