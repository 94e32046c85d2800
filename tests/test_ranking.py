import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.functions.text import fold_accents, query_tokens
from threadloom.operators import ranking

DOCS = [
    (1, "kind one", "the leftover argv issue in the parser"), (2, None, "argv argv argv leftover"), (3, "leftover argv", "nothing else"),
    (4, "x", "the parser is fine"), (5, None, "café parser résumé"), (6, "long", "word " * 60 + "argv leftover"), (7, None, ""), (8, "parser", "parser parser"),
]


@pytest.mark.parametrize("query", ["leftover argv", "parser", "argv argv", "cafe", "the", "absent", "Leftover, ARGV!"])
def test_bm25_equals_fts5(spark, query):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    words = query_tokens(query)
    found = {r["doc_id"]: r["bm25"] for r in ranking.bm25(ranking.postings(docs, fold_accents), ranking.lengths(docs, fold_accents), words).collect()}
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE d USING fts5(title, text)")
    con.executemany("INSERT INTO d(rowid, title, text) VALUES (?, ?, ?)", DOCS)
    match = " AND ".join(f'"{w}"' for w in words)
    wanted = dict(con.execute("SELECT rowid, bm25(d, 8.0, 1.0) FROM d WHERE d MATCH ?", (match,)))
    assert found.keys() == wanted.keys()
    for k, v in wanted.items():
        assert found[k] == pytest.approx(v, rel=1e-9)


def test_no_tokens_match_nothing(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    assert ranking.bm25(ranking.postings(docs), ranking.lengths(docs), query_tokens("?!")).count() == 0


def test_overlay_needs_whole_tokens_and_merge_keeps_the_first(spark):
    docs = spark.createDataFrame([("a", "user_message", None, "say help ok now"), ("b", "user_message", None, "helped okay"), ("c", "command_execution", "help", "ok")], "thread_id string, kind string, title string, text string")
    hits = {r["thread_id"]: r["score"] for r in ranking.overlay(docs, "help ok").collect()}
    assert hits == {"a": 1002.0, "c": 1202.0}
    first = spark.createDataFrame([("a", "x", 1.0)], "thread_id string, text string, score double")
    second = spark.createDataFrame([("a", "x", 9.0), ("b", "y", 2.0), ("b", "y", 2.0)], first.schema)
    merged = ranking.merge_hits(first, second, ["thread_id", "text"], 10)
    assert [tuple(r) for r in merged.collect()] == [("b", "y", 2.0), ("a", "x", 1.0)]


def test_heuristic(spark):
    row = spark.range(1).select(ranking.heuristic(" Foo bar ", F.lit(None).cast("string"), F.lit("a FOO BAR b"), F.lit("command_execution")).alias("h")).first()
    assert row["h"] == 1200.0
