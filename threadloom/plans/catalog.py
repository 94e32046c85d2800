"""The registered queries: each operator applied to whole tables, with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import redact, text
from threadloom.operators import fold, freshness, merge, ranking
from threadloom.operators import grep as greps
from threadloom.operators.scope import in_scope
from threadloom.plans import export
from threadloom.sources import logs
from threadloom.sources.tables import LOG_SPLIT, conversation_items, conversation_logs, event_logs, load, search_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ITEMS = """items AS (SELECT 'conv_' || conv_id AS thread_id, turn AS item_index,
  CASE role WHEN 'assistant' THEN 'agent_message' ELSE 'user_message' END AS kind, role, text FROM conversations)"""
DOCS = """docs AS (SELECT doc_id, 'doc_' || doc_id AS thread_id, CASE lang WHEN 'en' THEN 'agent_message' WHEN 'fr' THEN 'user_message'
  WHEN 'de' THEN 'command_execution' WHEN 'es' THEN 'reasoning_summary' ELSE 'other' END AS kind, source AS title, text FROM documents)"""
TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
BM25 = (
    r"""postings AS (SELECT doc_id, tok, count(*) FILTER (part = 0) AS title_tf, count(*) FILTER (part = 1) AS text_tf FROM (
  SELECT doc_id, 0 AS part, unnest(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+')) AS tok FROM docs UNION ALL
  SELECT doc_id, 1, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) FROM docs) WHERE tok <> '' GROUP BY ALL),
sizes AS (SELECT doc_id, sum(title_tf + text_tf) AS n FROM postings GROUP BY ALL),
corpus AS (SELECT (SELECT count(*) FROM docs) AS big_n, (SELECT sum(n) FROM sizes) / (SELECT count(*) FROM docs) AS mean),
df AS (SELECT tok, count(*) AS df FROM postings GROUP BY tok),
parts AS (SELECT p.doc_id, p.tok, 8.0 * title_tf + text_tf AS f, n,
  CASE WHEN ln((big_n - df + 0.5) / (df + 0.5)) > 0 THEN ln((big_n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, mean
  FROM postings p JOIN df USING (tok) JOIN sizes USING (doc_id) CROSS JOIN corpus WHERE p.tok IN ({tokens})),
scored AS (SELECT doc_id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM parts GROUP BY doc_id HAVING count(*) = {n})"""
)
SEARCH = "with this"
SEARCH_TOKENS = ["with", "this"]
PATTERN = "(?:tion|ing) (?:the|that)"
PHRASE = "of the"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def bm25_sql(tokens: list[str]) -> str:
    return BM25.replace("{tokens}", ", ".join(f"'{t}'" for t in sorted(set(tokens)))).replace("{n}", str(len(set(tokens))))


# Threads and turns


@query("thread_list", f"""WITH {ITEMS} SELECT thread_id, count(*) AS items_count, count(*) FILTER (kind = 'user_message') AS user_messages,
  count(*) FILTER (kind = 'agent_message') AS agent_messages, min(item_index) AS first_index, max(item_index) AS last_index FROM items GROUP BY 1""")
def thread_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda kind: F.count_if(F.col("kind") == kind)
    found = conversation_items(spark, sf_dir).groupBy("thread_id").agg(
        F.count("*").alias("items_count"), of("user_message").alias("user_messages"), of("agent_message").alias("agent_messages"),
        F.min("item_index").alias("first_index"), F.max("item_index").alias("last_index"),
    )
    return found.orderBy(F.desc("items_count"), "thread_id")


@query("thread_show_flat", f"""WITH {ITEMS} SELECT thread_id, item_index, kind, text, row_number() OVER (PARTITION BY thread_id ORDER BY item_index) AS position,
  count(*) OVER (PARTITION BY thread_id) AS items_count FROM items""")
def thread_show_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Window.partitionBy("thread_id")
    rows = conversation_items(spark, sf_dir).select("thread_id", "item_index", "kind", "text")
    return rows.withColumn("position", F.row_number().over(at.orderBy("item_index")).cast("long")).withColumn("items_count", F.count("*").over(at))


@query("thread_preview", f"""WITH {ITEMS} SELECT thread_id, arg_min(text, item_index) FILTER (role = 'user' AND trim(text) <> '') AS preview FROM items GROUP BY 1""")
def thread_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = (F.col("role") == "user") & (F.trim("text") != "")
    return conversation_items(spark, sf_dir).groupBy("thread_id").agg(F.min_by("text", F.when(shown, F.col("item_index"))).alias("preview"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.running_turn(conversation_items(spark, sf_dir), F.col("kind") == "user_message", ["thread_id"], ["item_index"])


TURNS = f"""WITH {ITEMS}, turns AS (SELECT *, CAST(sum(CASE WHEN kind = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY item_index) AS BIGINT) AS turn_no FROM items)"""


@query("turn_assignment", f"{TURNS} SELECT thread_id, item_index, kind, turn_no FROM turns")
def turn_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("thread_id", "item_index", "kind", "turn_no")


@query("turn_rollup", f"""{TURNS} SELECT thread_id, turn_no, min(item_index) AS first_index, max(item_index) AS last_index, count(*) AS items_count,
  CASE WHEN count(*) FILTER (kind = 'agent_message') > 0 THEN 'completed' ELSE 'in_progress' END AS status FROM turns GROUP BY 1, 2""")
def turn_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.count_if(F.col("kind") == "agent_message") > 0, "completed").otherwise("in_progress")
    return _turns(spark, sf_dir).groupBy("thread_id", "turn_no").agg(F.min("item_index").alias("first_index"), F.max("item_index").alias("last_index"), F.count("*").alias("items_count"), status.alias("status"))


# Event streams


@query("event_turn_ffill", """SELECT event_id, user_id, event_type,
  last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_turn FROM events""")
def event_turn_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = F.when(F.col("event_type") == "signup", F.col("event_id"))
    rows = fold.forward_fill(load(spark, sf_dir, "events"), marker, ["user_id"], ["ts", "event_id"], "current_turn")
    return rows.select("event_id", "user_id", "event_type", "current_turn")


@query("implicit_promotion", """WITH m AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN 'turn-' || (CAST(floor(value) AS BIGINT) % 7) END AS ex,
    'implicit:' || user_id || ':' || event_id AS im FROM events WHERE event_type IN ('signup', 'view')),
  n AS (SELECT *, ex IS NOT NULL AND row_number() OVER (PARTITION BY user_id, ex ORDER BY ts, event_id) = 1 AS f FROM m)
  SELECT user_id, event_id, coalesce(ex, lead(CASE WHEN f THEN ex END) OVER (PARTITION BY user_id ORDER BY ts, event_id), im) AS turn_id FROM n""")
def implicit_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "view"))
    named = F.concat(F.lit("turn-"), (F.floor("value").cast("long") % 7).cast("string"))
    rows = rows.withColumn("ex", F.when(F.col("event_type") == "signup", named)).withColumn("im", F.concat_ws(":", F.lit("implicit"), F.col("user_id").cast("string"), F.col("event_id").cast("string")))
    return fold.promote(rows, ["user_id"], ["ts", "event_id"], "ex", "im", "turn_id").select("user_id", "event_id", "turn_id")


PAIRED = """WITH m AS (SELECT * FROM events WHERE event_type IN ('click', 'purchase'))"""


def _call(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list, list, Column, Column]:
    kind = F.col("event_type")
    return load(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], kind == "click", kind == "purchase"


@query("call_output_pairing", f"""{PAIRED}, p AS (SELECT *, lag(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call FROM m)
  SELECT event_id AS output_id, user_id, call AS call_id, value AS output_value FROM p WHERE event_type = 'purchase'""")
def call_output_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, by, order, call, output = _call(spark, sf_dir)
    paired = fold.pair_calls(rows, by, order, call, output, F.col("event_id"), "call_id").where(output)
    return paired.select(F.col("event_id").alias("output_id"), "user_id", "call_id", F.col("value").alias("output_value"))


@query("pending_unmatched", f"""{PAIRED}, p AS (SELECT *, lead(1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM m)
  SELECT event_id, user_id FROM p WHERE event_type = 'click' AND nxt IS NULL""")
def pending_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.pending_calls(*_call(spark, sf_dir), "open").where("open").select("event_id", "user_id")


@query("event_json_project", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
def event_json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.try_parse_json("props")
    return load(spark, sf_dir, "events").select("event_id", F.try_variant_get(props, "$.k", "int").alias("k"))


@query("malformed_count", """SELECT event_type, count(*) AS lines, count(*) FILTER (NOT json_valid(l)) AS malformed FROM
  (SELECT event_type, CASE WHEN value > 15 THEN left(props, length(props) - 1) ELSE props END AS l FROM events) GROUP BY 1""")
def malformed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    cut = F.when(F.col("value") > 15, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return rows.groupBy("event_type").agg(F.count("*").alias("lines"), F.count_if(F.try_parse_json(cut).isNull()).alias("malformed"))


# Shards


SHARDS = """WITH s AS (SELECT user_id, event_id % 3 AS seq, epoch_us(min(ts)) AS created, CASE WHEN count(*) % 4 <> 0 THEN epoch_us(max(ts)) END AS updated,
  CASE WHEN count(*) % 3 <> 0 THEN arg_max(event_type, event_id) END AS status, arg_min(props, event_id) AS preview, count(*) AS n FROM events GROUP BY ALL)"""


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 3).alias("seq"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return rows.agg(
        micros(F.min("ts")).alias("created"),
        F.when(F.count("*") % 4 != 0, micros(F.max("ts"))).alias("updated"),
        F.when(F.count("*") % 3 != 0, F.max_by("event_type", "event_id")).alias("status"),
        F.min_by("props", "event_id").alias("preview"),
        F.count("*").alias("n"),
    )


@query("shard_merge_summary", f"""{SHARDS}, o AS (SELECT *, coalesce(updated, created) AS fresh,
    coalesce(max(updated) OVER w, min(created) OVER w) AS old, min(created) OVER w AS c0, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM s
    WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  r AS (SELECT *, rn = 1 OR fresh > old OR (fresh = old AND created >= c0) AS rec FROM o)
  SELECT user_id, min(created) AS created_us, max(updated) AS updated_us, arg_min(preview, seq) AS preview,
    coalesce(arg_max(status, seq) FILTER (rec AND status IS NOT NULL), arg_min(status, seq) FILTER (status IS NOT NULL)) AS status,
    CAST(sum(n) AS BIGINT) AS items_count FROM r GROUP BY 1""")
def shard_merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.fresher(_shards(spark, sf_dir), ["user_id"], "seq", "updated", "created")
    return rows.groupBy("user_id").agg(
        F.min("created").alias("created_us"), F.max("updated").alias("updated_us"), merge.first_known("preview", "seq").alias("preview"),
        merge.preferred("status", "seq").alias("status"), F.sum("n").alias("items_count"),
    )


@query("shard_merge_command", f"""{SHARDS} SELECT user_id, arg_min(status, seq) FILTER (status IS NOT NULL) AS status, arg_min(updated, seq) FILTER (updated IS NOT NULL) AS updated_us, count(*) AS shards FROM s GROUP BY 1""")
def shard_merge_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shards(spark, sf_dir).groupBy("user_id").agg(merge.first_known("status", "seq").alias("status"), merge.first_known("updated", "seq").alias("updated_us"), F.count("*").alias("shards"))


@query("name_backfill_join", """WITH t AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN props END) AS name, count(*) AS n FROM events GROUP BY 1)
  SELECT user_id, n, coalesce(name, c_name) AS name FROM t LEFT JOIN customer ON c_custkey = user_id""")
def name_backfill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = load(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", F.col("props"))).alias("name"), F.count("*").alias("n"))
    names = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return merge.back_fill(threads, names, "user_id", "name").select("user_id", "n", "name")


# Grep and counting


#: Of a literal's occurrences those of its words count, or else those of the whole.
LITERAL = f"""SELECT thread_id, item_index, kind, text, coalesce(nullif(CAST(len(list_filter({TOKENS.format('text')}, lambda t: t IN ('of', 'the'))) AS BIGINT), 0),
  greatest(CAST((length(text) - length(replace(lower(text), '{PHRASE}', ''))) / {len(PHRASE)} AS BIGINT), 1)) AS occurrences FROM items WHERE contains(text, '{PHRASE}')"""


@query("grep_literal", f"WITH {ITEMS} {LITERAL}")
def grep_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greps.grep(conversation_items(spark, sf_dir), PHRASE).select("thread_id", "item_index", "kind", "text", "occurrences")


@query("grep_regex", f"WITH {ITEMS} SELECT thread_id, item_index, kind, CAST(len(regexp_extract_all(text, '{PATTERN}')) AS BIGINT) AS occurrences FROM items WHERE regexp_matches(text, '{PATTERN}')")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greps.grep(conversation_items(spark, sf_dir), PATTERN, regex=True).select("thread_id", "item_index", "kind", "occurrences")


@query("grep_scope_kinds", f"WITH {DOCS} SELECT doc_id, kind, length(text) AS n_chars FROM docs WHERE kind IN ('user_message', 'agent_message', 'reasoning_summary') AND contains(text, 'de la')")
def grep_scope_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greps.grep(search_documents(spark, sf_dir), "de la", thinking=True).select("doc_id", "kind", F.length("text").cast("long").alias("n_chars"))


@query("grep_grouped", f"""WITH {ITEMS}, h AS ({LITERAL}), k AS (SELECT thread_id, kind, count(*) AS hits, sum(occurrences) AS occ, min(item_index) AS pos FROM h GROUP BY ALL)
  SELECT k.thread_id, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(occ) AS BIGINT) AS occurrences, string_agg(kind, ',' ORDER BY pos) AS kinds,
  any_value(f.text) AS first_text FROM k JOIN (SELECT thread_id, arg_min(text, item_index) AS text FROM h GROUP BY 1) f USING (thread_id) GROUP BY 1""")
def grep_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = greps.grouped(greps.grep(conversation_items(spark, sf_dir), PHRASE), ["item_index"])
    return found.select("thread_id", "hits", "occurrences", F.array_join("kinds", ",").alias("kinds"), "first_text")


@query("occurrences_tokens", f"SELECT doc_id, CAST(len(list_filter({TOKENS.format('text')}, lambda t: t IN ('with', 'this'))) AS BIGINT) AS occurrences FROM documents")
def occurrences_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text"), SEARCH_TOKENS).alias("occurrences"))


#: A letter of any script that is no ASCII one, within words; DuckDB's own syntax has to spell the classes out.
UNICODE_PATTERN, UNICODE_WORDS = r"(?i)\w*[É-ÿ]\w+[[:punct:]]", r"(?i)[\p{L}\p{M}\p{Nd}\p{Pc}]*[É-ÿ][\p{L}\p{M}\p{Nd}\p{Pc}]+[!-/:-@\[-`{-~]"


@query("grep_unicode", rf"WITH {ITEMS} SELECT thread_id, item_index, CAST(len(regexp_extract_all(text, '{UNICODE_WORDS}')) AS BIGINT) AS occurrences FROM items WHERE regexp_matches(text, '{UNICODE_WORDS}')")
def grep_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greps.grep(conversation_items(spark, sf_dir), UNICODE_PATTERN, regex=True).select("thread_id", "item_index", "occurrences")


@query("occurrences_regex", f"SELECT doc_id, greatest(CAST(len(regexp_extract_all(text, '{PATTERN}')) AS BIGINT), 1) AS occurrences FROM documents")
def occurrences_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.regex_count(F.col("text"), PATTERN).alias("occurrences"))


@query("occurrences_substring", "SELECT doc_id, CAST((length(l) - length(replace(l, 'the ', ''))) / 4 AS BIGINT) AS occurrences FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM documents)")
def occurrences_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.substring_count(F.col("text"), F.lit("The ")).alias("occurrences"))


# Text forms


LINE = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("compact_single_line", f"SELECT doc_id, {LINE} AS line FROM documents")
def compact_single_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.compact_line(F.col("text")).alias("line"))


@query("compact_preview", f"SELECT doc_id, CASE WHEN length(l) > 160 THEN substr(l, 1, 160) || '...' ELSE l END AS preview FROM (SELECT doc_id, {LINE} AS l FROM documents)")
def compact_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.compact_preview(F.col("text")).alias("preview"))


#: The trimmed lines of a text that are not blank, whatever white space there is.
COMPACT = r"array_to_string(list_filter(list_transform(string_split({}, chr(10)), lambda x: regexp_replace(x, '^[\s\x0B\x{{85}}\p{{Z}}]+|[\s\x0B\x{{85}}\p{{Z}}]+$', '', 'g')), lambda x: x <> ''), ' / ')"


@query("compact_text", f"SELECT doc_id, {COMPACT.format('t')} AS compact FROM (SELECT doc_id, replace(replace(text, '. ', '.' || chr(9) || chr(13) || chr(10) || chr(160)), ', ', chr(10) || chr(9) || chr(10) || ' ') AS t FROM documents)")
def compact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with line ends of several kinds and lines of white space put between sentences."""
    lines = F.replace(F.replace("text", F.lit(". "), F.lit(".\t\r\n\u00a0")), F.lit(", "), F.lit("\n\t\n "))
    return load(spark, sf_dir, "documents").select("doc_id", text.compact_text(lines).alias("compact"))


@query("grep_hit_ids", f"""WITH {ITEMS}, h AS ({LITERAL}) SELECT thread_id || ':t' || item_index || ':' || kind || ':' || row_number() OVER (PARTITION BY thread_id ORDER BY item_index) AS hit_id, occurrences FROM h""")
def grep_hit_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = conversation_items(spark, sf_dir).withColumn("turn_id", F.concat(F.lit("t"), "item_index"))
    return greps.hit_rows(greps.grep(items, PHRASE), ["item_index"]).select("hit_id", "occurrences")


@query("markdown_cells", f"""WITH {ITEMS}, h AS ({LITERAL}), t AS (SELECT thread_id, arg_min(text, item_index) FILTER (role = 'user' AND trim(text) <> '') AS preview FROM items GROUP BY 1),
  c AS (SELECT *, unnest([CASE kind WHEN 'user_message' THEN 'user' ELSE 'assistant' END]) AS label FROM h JOIN t USING (thread_id))
  SELECT thread_id, item_index, '| ' || label || ' | ' || thread_id || ' | ' || replace({LINE.replace("text", "coalesce(preview, '(unnamed)')")}, '|', '\\|') || ' | - | ' || replace({LINE}, '|', '\\|') || ' |' AS line FROM c""")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = thread_preview(spark, sf_dir).withColumns({"name": F.lit(" "), "cwd": F.lit(None).cast("string")})
    return greps.table_rows(greps.grep(conversation_items(spark, sf_dir), PHRASE), threads).select("thread_id", "item_index", "line")


# Index and ranked search


@query("doc_tokens", rf"""SELECT token, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY 1""")
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("token", "doc_id").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


@query("postings", f"WITH {DOCS}, {bm25_sql(['x'])} SELECT tok AS token, doc_id, title_tf, text_tf FROM postings")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.postings(search_documents(spark, sf_dir))


@query("fts_match_and", f"WITH {DOCS}, {bm25_sql(SEARCH_TOKENS)} SELECT doc_id, count(DISTINCT tok) AS n_matched FROM postings WHERE tok IN ('with', 'this') GROUP BY 1 HAVING count(DISTINCT tok) = 2")
def fts_match_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.matches(ranking.postings(search_documents(spark, sf_dir)), SEARCH_TOKENS)


def _scored(spark: SparkSession, sf_dir: str, words: str) -> tuple[DataFrame, DataFrame]:
    docs = search_documents(spark, sf_dir)
    return docs, ranking.bm25(ranking.postings(docs), ranking.lengths(docs), text.query_tokens(words))


@query("bm25_topk", f"WITH {DOCS}, {bm25_sql(SEARCH_TOKENS)} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored ORDER BY round(bm25, 9), doc_id LIMIT 50")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scored = _scored(spark, sf_dir, SEARCH)
    return scored.orderBy(F.round("bm25", 9), "doc_id").limit(ranking.LIMIT).select("doc_id", F.round("bm25", 6).alias("bm25"))


BOOST = "CASE WHEN contains(lower(title), '{q}') OR contains(lower(text), '{q}') THEN 1000.0 ELSE 0.0 END + CASE WHEN kind = 'command_execution' THEN 200.0 ELSE 0.0 END"


def _search_sql(words: str, kinds: str) -> str:
    tokens = text.query_tokens(words)
    return f"""WITH {DOCS}, {bm25_sql(tokens)}, r AS (SELECT d.*, bm25, {BOOST.format(q=words)} AS h FROM docs d JOIN scored USING (doc_id) WHERE kind IN ({kinds}))
  SELECT doc_id, thread_id, kind, CAST(round(h - bm25, 6) AS DOUBLE) AS score FROM r ORDER BY h DESC, round(bm25, 9), doc_id LIMIT 50"""


def _search(spark: SparkSession, sf_dir: str, words: str, **scope: bool) -> DataFrame:
    docs, scored = _scored(spark, sf_dir, words)
    found = ranking.top(ranking.rank(docs.where(in_scope(F.col("kind"), **scope)), scored, words))
    return found.select("doc_id", "thread_id", "kind", F.round("score", 6).alias("score"))


@query("search_ranked", _search_sql(SEARCH, "'user_message', 'agent_message'"))
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, SEARCH)


@query("search_scope_tools", _search_sql("nicht", "'user_message', 'agent_message', 'reasoning_summary', 'command_execution', 'web_search', 'mcp_tool_call'"))
def search_scope_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "nicht", thinking=True, tools=True)


# Freshness


def _print_sql(value: str) -> str:
    parts = " || '-' || ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {1 + 16 * i}, 16) AS UBIGINT) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)" for i in range(4))
    return f"SELECT thread_id, {parts} AS content_fingerprint FROM (SELECT thread_id, sha256(item_index || chr(31) || kind || chr(31) || {value}) AS h FROM items) GROUP BY 1"


def _digest_sql(value: str) -> str:
    hashes = f"SELECT thread_id, item_index, sha256(kind || chr(31) || coalesce({value}, '')) AS h FROM items"
    return f"SELECT thread_id, sha256(string_agg(h, chr(10) ORDER BY item_index, h)) AS content_fingerprint FROM ({hashes}) GROUP BY 1"


EDITED = "CASE WHEN role = 'assistant' AND length(text) > 2000 THEN text || ' edited' ELSE text END"


def _fresh_sql(prints: Callable[[str], str]) -> str:
    return f"""WITH {ITEMS}, old AS (SELECT o.* FROM ({prints(EDITED)}) o JOIN (SELECT thread_id, count(*) AS n FROM items GROUP BY 1) USING (thread_id) WHERE n <> 4),
  cur AS ({prints('text')}),
  cls AS (SELECT cur.thread_id, cur.content_fingerprint, CASE WHEN old.thread_id IS NULL THEN 'new' WHEN old.content_fingerprint <> cur.content_fingerprint THEN 'changed' ELSE 'unchanged' END AS freshness
    FROM cur LEFT JOIN old USING (thread_id))"""


FRESH = _fresh_sql(_print_sql)


def _sums(items: DataFrame) -> DataFrame:
    return freshness.fingerprints(items, ["item_index"], ["kind", "text"])


def _digests(items: DataFrame) -> DataFrame:
    return freshness.digests(items, "item_index", ["kind", "text"])


@query("manifest_build", f"WITH {ITEMS} {_digest_sql('text')}")
def manifest_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(conversation_items(spark, sf_dir))


def _states(spark: SparkSession, sf_dir: str, prints: Callable[[DataFrame], DataFrame] = _sums) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items now, an index made when long answers read otherwise and threads of four items were missing, and the classes."""
    items = conversation_items(spark, sf_dir)
    before = items.withColumn("text", F.when((F.col("role") == "assistant") & (F.length("text") > 2000), F.concat("text", F.lit(" edited"))).otherwise(F.col("text")))
    known = items.groupBy("thread_id").agg(F.count("*").alias("n")).where("n <> 4").select("thread_id")
    before = before.join(known, "thread_id", "left_semi")
    return items, before, freshness.classify(prints(items), prints(before))


@query("freshness_classify", f"{_fresh_sql(_digest_sql)} SELECT thread_id, content_fingerprint, freshness FROM cls")
def freshness_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir, _digests)[2]


@query("freshness_counts", f"{FRESH} SELECT freshness, count(*) AS threads FROM cls GROUP BY 1")
def freshness_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)[2].groupBy("freshness").agg(F.count("*").alias("threads"))


@query("refresh_upsert", f"""{FRESH}, was AS (SELECT thread_id, item_index, kind, {EDITED} AS text FROM items WHERE thread_id IN (SELECT thread_id FROM old))
  SELECT thread_id, item_index, kind, text FROM was WHERE thread_id NOT IN (SELECT thread_id FROM cls WHERE freshness <> 'unchanged')
  UNION ALL SELECT thread_id, item_index, kind, text FROM items WHERE thread_id IN (SELECT thread_id FROM cls WHERE freshness <> 'unchanged')""")
def refresh_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, before, classes = _states(spark, sf_dir)
    return freshness.refreshed(before, items, classes).select("thread_id", "item_index", "kind", "text")


@query("fresh_overlay_merge", f"""WITH {DOCS}, {bm25_sql(SEARCH_TOKENS)}, changed AS (SELECT DISTINCT 'doc_' || doc_id AS thread_id FROM labels WHERE quality = 1),
  idx AS (SELECT thread_id, kind, text, {BOOST.format(q=SEARCH)} - bm25 AS score, 0 AS src FROM docs JOIN scored USING (doc_id) WHERE kind IN ('user_message', 'agent_message') AND thread_id NOT IN (SELECT thread_id FROM changed)),
  tk AS (SELECT *, {TOKENS.format("title || chr(10) || text")} AS toks FROM docs WHERE kind IN ('user_message', 'agent_message') AND thread_id IN (SELECT thread_id FROM changed)),
  ov AS (SELECT thread_id, kind, text, CASE WHEN contains(' ' || array_to_string(toks, ' ') || ' ', ' with this ') THEN 1000.0 ELSE 0.0 END + 2.0 AS score, 1 AS src FROM tk WHERE list_has_all(toks, ['with', 'this'])),
  b AS (SELECT *, row_number() OVER (PARTITION BY thread_id, kind, text ORDER BY src, score DESC) AS rn FROM (SELECT * FROM idx UNION ALL SELECT * FROM ov))
  SELECT thread_id, kind, CAST(round(score, 6) AS DOUBLE) AS score FROM b WHERE rn = 1 ORDER BY round(b.score, 9) DESC, thread_id, kind, text LIMIT 50""")
def fresh_overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scored = _scored(spark, sf_dir, SEARCH)
    docs = docs.where(in_scope(F.col("kind")))
    changed = load(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("thread_id")).distinct()
    columns = ["thread_id", "kind", "text", "score"]
    indexed = ranking.rank(docs, scored, SEARCH).join(changed, "thread_id", "left_anti").select(columns)
    overlaid = ranking.overlay(docs.join(changed, "thread_id", "left_semi"), SEARCH).select(columns)
    merged = ranking.merge_hits(indexed, overlaid, ["thread_id", "kind", "text"])
    best = merged.orderBy(F.desc(F.round("score", 9)), "thread_id", "kind", "text").limit(ranking.LIMIT)
    return best.select("thread_id", "kind", F.round("score", 6).alias("score"))


@query("index_doctor_counts", f"""WITH {ITEMS}, {DOCS} SELECT 'threads' AS name, count(DISTINCT thread_id) AS rows FROM items UNION ALL SELECT 'items', count(*) FROM items UNION ALL SELECT 'search_docs', count(*) FROM docs""")
def index_doctor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, docs = conversation_items(spark, sf_dir), search_documents(spark, sf_dir)
    row = lambda name, frame: frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
    return row("threads", items.select("thread_id").distinct()).unionByName(row("items", items)).unionByName(row("search_docs", docs))


@query("watermark", "SELECT epoch_us(max(ts)) AS watermark_us, count(DISTINCT user_id) AS threads FROM events")
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("watermark_us"), F.count_distinct("user_id").alias("threads"))


# Redaction and exports


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _secrets_sql(value: str) -> str:
    for pattern, put in ((redact.JWT, redact.MARK), (redact.BEARER, rf"\1{redact.MARK}"), (redact.QUOTED, rf"\1\2{redact.MARK}\2"), (redact.BARE, rf"\1{redact.MARK}"), (redact.VENDOR, redact.MARK)):
        value = f"regexp_replace({value}, '{_re2(pattern)}', '{put}', 'g')"
    return value


@query("redact_secrets", f"SELECT doc_id, {_secrets_sql('text')} AS text FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", redact.secrets(F.col("text")).alias("text"))


@query("redact_home_paths", rf"SELECT doc_id, regexp_replace('cd /home/u' || doc_id || '/x and (/Users/' || source || '): ' || text, '{_re2(redact.HOME)}', '\1~\2', 'g') AS text FROM documents")
def redact_home_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    return rows.select("doc_id", redact.home_paths(F.concat(F.lit("cd /home/u"), "doc_id", F.lit("/x and (/Users/"), "source", F.lit("): "), "text")).alias("text"))


@query("redact_json_values", f"SELECT doc_id, source AS \"public\", '{redact.MARK}' AS secret, {_secrets_sql('text')} AS body FROM documents")
def redact_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    fields = redact.json_values(F.create_map(F.lit("public"), F.col("source"), F.lit("Api-Key"), F.col("lang"), F.lit("body"), F.col("text")))
    return rows.withColumn("f", fields).select("doc_id", F.col("f")["public"].alias("public"), F.col("f")["Api-Key"].alias("secret"), F.col("f")["body"].alias("body"))


@query("notable_errors", "SELECT event_id, user_id, event_type || ' exited with code ' || CAST(floor(value) AS INT) AS error FROM events WHERE regexp_matches(event_type, '(?i)error|failed|panic|traceback|fatal') AND floor(value) <> 0")
def notable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").withColumn("code", F.floor("value").cast("int"))
    found = rows.where(export.names_an_error(F.col("event_type")) & (F.col("code") != 0))
    return found.select("event_id", "user_id", F.concat(F.col("event_type"), F.lit(" exited with code "), F.col("code").cast("string")).alias("error"))


# Session logs: lines made of conversations go the way of log files, from parsing to exports


#: What the made lines say, turn by turn; ``tables.conversation_logs`` has the rules. A conversation's
#: second file begins at the first question from its fifth row on. ``kind``: a made item; ``turn_id``: its turn.
SAID = f"""rows AS (SELECT conv_id AS c, turn AS t, role, text, 'conv_' || conv_id AS thread_id, conv_id % 4 = 1 AS bare, TIMESTAMP '2026-01-01' + to_minutes(conv_id * 10) AS base,
    coalesce(turn >= min(turn) FILTER (role = 'user' AND turn >= {LOG_SPLIT}) OVER (PARTITION BY conv_id), false) AS late FROM conversations),
  asked AS (SELECT *, CASE WHEN role = 'user' THEN t END AS q, lead(t) OVER w AS next_t, lead(role) OVER w AS next_role, lead(late) OVER w AS next_late FROM rows WHERE role <> 'system' WINDOW w AS (PARTITION BY c ORDER BY t)),
  named AS (SELECT *, CASE WHEN role = 'user' THEN CASE WHEN NOT bare THEN 't' || t WHEN next_role = 'assistant' AND next_late = late THEN 'a' || next_t
      ELSE 'implicit:' || left(md5('made/' || c || '-' || CAST(late AS INT) || '.jsonl'), 16) || ':' || count(*) FILTER (role = 'user') OVER (PARTITION BY c, late ORDER BY t) END END AS own FROM asked),
  said AS (SELECT *, last_value(own IGNORE NULLS) OVER w AS turn_id, last_value(q IGNORE NULLS) OVER w AS asked_at FROM named WINDOW w AS (PARTITION BY c ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  turns AS (SELECT thread_id, turn_id, asked_at, CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 'completed' ELSE 'in_progress' END AS status, min(base + to_seconds(asked_at * 10 + 1)) AS started_at,
    max(base + to_seconds(t * 10 + 5)) FILTER (role = 'assistant') AS completed_at FROM said GROUP BY 1, 2, 3),
  parts AS (SELECT s.*, k.* FROM said s, (VALUES ('user', 2, 'user_message'), ('assistant', 2, 'command_execution'), ('assistant', 3, 'reasoning_summary'), ('assistant', 4, 'agent_message')) AS k(who, line, kind) WHERE role = who),
  made AS (SELECT *, CASE kind WHEN 'command_execution' THEN NULL WHEN 'reasoning_summary' THEN 'Thought ' || t ELSE text END AS said_text, CASE WHEN kind = 'command_execution' THEN 'run ' || t END AS command,
    CASE WHEN kind = 'command_execution' THEN text END AS output, row_number() OVER (PARTITION BY c, turn_id ORDER BY t, line) - 1 AS item_index FROM parts)"""
THREADS = """threads AS (SELECT thread_id, CASE WHEN c % 3 = 0 THEN 'Conversation ' || c END AS name, arg_min(text, t) FILTER (role = 'user') AS preview, min(base) AS created_at,
    coalesce(max(base + to_seconds(t * 10 + CASE role WHEN 'user' THEN 2 ELSE 5 END)) FILTER (role <> 'system'), min(base)) AS updated_at, '/work/' || (c % 7) AS cwd, 'cli' AS source_kind,
    CASE WHEN coalesce(arg_max(role, t) FILTER (late = last_late AND (NOT bare OR role = 'assistant') AND role <> 'system') = 'assistant', false) THEN 'completed' ELSE 'running' END AS status,
    count(*) FILTER (role = 'user') + 3 * count(*) FILTER (role = 'assistant') AS items_count, count(*) FILTER (role = 'assistant') AS commands_count
    FROM (SELECT *, bool_or(late) OVER (PARTITION BY c) AS last_late FROM rows) GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY thread_id, c")


def _history(spark: SparkSession, sf_dir: str) -> logs.History:
    return logs.from_lines(conversation_logs(spark, sf_dir))


@query("logs_threads", f"""WITH {SAID}, {THREADS} SELECT thread_id, name, preview, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us, cwd, source_kind, status, items_count, commands_count FROM threads""")
def logs_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = [F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("created", "updated")]
    return _history(spark, sf_dir).threads.select("thread_id", "name", "preview", *times, "cwd", "source_kind", "status", "items_count", "commands_count")


@query("logs_turns", f"""WITH {SAID} SELECT thread_id, turn_id, status, epoch_us(started_at) AS started_us, epoch_us(completed_at) AS completed_us, row_number() OVER (PARTITION BY thread_id ORDER BY asked_at) - 1 AS turn_pos FROM turns""")
def logs_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = [F.unix_micros(f"{c}_at").alias(f"{c}_us") for c in ("started", "completed")]
    return _history(spark, sf_dir).turns.select("thread_id", "turn_id", "status", *times, "turn_pos")


@query("logs_items", f"""WITH {SAID} SELECT thread_id, turn_id, item_index, kind, said_text AS text, command, output, CASE WHEN command IS NOT NULL THEN '"k' || t || '"' END AS call_id FROM made""")
def logs_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).items.select("thread_id", "turn_id", "item_index", "kind", "text", "command", "output", F.col("attributes")["call_id"].alias("call_id"))


@query("logs_files", f"""WITH {SAID}, f AS (SELECT c, late, count(*) FILTER (role = 'system') AS bad FROM rows GROUP BY ALL)
  SELECT 'made/' || c || '-' || CAST(late AS INT) || '.jsonl' AS path, 'conv_' || c AS thread_id, bad + CASE WHEN c % 5 = 0 THEN 2 ELSE 0 END AS malformed_lines FROM f""")
def logs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).files.select("path", "thread_id", "malformed_lines")


EVENT_LINES = "e AS (SELECT *, event_id % 10 AS n, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


@query("logs_kinds", f"""WITH {EVENT_LINES} SELECT 'user_' || user_id AS thread_id, 't' AS turn_id, row_number() OVER (PARTITION BY user_id ORDER BY n = 8, event_id) - 1 AS item_index,
  ['reasoning_summary', 'event:note', 'agent_message', 'user_message', 'mcp_tool_call', 'web_search_call', 'file_change', 'event:ping', 'command_execution', 'reasoning_summary'][n + 1] AS kind, n NOT IN (1, 5, 7) AS is_typed,
  CASE n WHEN 0 THEN 'why ' || k WHEN 2 THEN event_type || chr(10) || chr(10) || 'part ' || k WHEN 3 THEN event_type WHEN 9 THEN 'inner ' || k END AS text, CASE WHEN n = 8 THEN 'run ' || k || ' now' END AS command,
  CASE WHEN n = 6 THEN 'src/' || k || '.rs' END AS path, CASE WHEN n = 4 THEN event_type END AS tool, CASE WHEN n = 4 THEN '{{"k":' || k || '}}' END AS arguments,
  CASE WHEN n IN (1, 5, 6, 7) THEN CAST(k AS VARCHAR) END AS k, CASE WHEN n IN (4, 8) THEN '"c' || event_id || '"' END AS call_id FROM e""")
def logs_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all kinds of lines, with calls that are never answered at the end of their turn."""
    items = logs.from_lines(event_logs(spark, sf_dir)).items
    return items.select("thread_id", "turn_id", "item_index", "kind", "is_typed", "text", "command", "path", "tool", "arguments", *[F.col("attributes")[c].alias(c) for c in ("k", "call_id")])


@query("logs_kinds_threads", f"""WITH {EVENT_LINES} SELECT 'user_' || user_id AS thread_id, 'running' AS status, arg_min(event_type, event_id) FILTER (n = 3) AS preview, count(*) AS items_count,
  count(*) FILTER (n = 8) AS commands_count, count(*) FILTER (n = 6) AS files_changed_count FROM e GROUP BY user_id""")
def logs_kinds_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = logs.from_lines(event_logs(spark, sf_dir)).threads
    return threads.select("thread_id", "status", "preview", "items_count", "commands_count", "files_changed_count")


TIME = "strftime({}, '%Y-%m-%dT%H:%M:%S+00:00')"


@query("export_markdown", f"""WITH {SAID}, {THREADS}, lines AS (
    SELECT thread_id, asked_at AS a, 0 AS b, 0 AS d, '### ' || turn_id || chr(10) || '- Status: ' || status || chr(10) || '- Started At: ' || {TIME.format('started_at')} || coalesce(chr(10) || '- Completed At: ' || {TIME.format('completed_at')}, '') AS line FROM turns
    UNION ALL SELECT thread_id, asked_at, 1, item_index, CASE kind WHEN 'user_message' THEN '- User Message: ' || {COMPACT.format('said_text')} WHEN 'agent_message' THEN '- Agent Message: ' || {COMPACT.format('said_text')}
      WHEN 'reasoning_summary' THEN '- Reasoning Summary: ' || said_text ELSE '- Command: `' || command || '`' || chr(10) || '- Command Output: ' || {COMPACT.format('output')} END FROM made
    UNION ALL SELECT thread_id, asked_at, 2, 0, '' FROM turns),
  body AS (SELECT thread_id, string_agg(line, chr(10) ORDER BY a, b, d) AS body, count(*) FILTER (b = 0) AS n FROM lines GROUP BY 1),
  runs AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY t) AS k FROM made WHERE kind = 'command_execution'),
  commands AS (SELECT thread_id, string_agg('### Command ' || k || chr(10) || '- Command: `' || command || '`' || chr(10) || '- Output: ' || {COMPACT.format('output')} || chr(10), chr(10) ORDER BY k) AS commands FROM runs GROUP BY 1),
  first AS (SELECT thread_id, v, min((t, line)) AS pos FROM (SELECT *, {COMPACT.format('said_text')} AS v FROM made WHERE kind IN ('agent_message', 'reasoning_summary')) WHERE v <> '' GROUP BY ALL),
  notes AS (SELECT thread_id, string_agg('- ' || v, chr(10) ORDER BY pos) AS notes FROM first GROUP BY 1)
  SELECT thread_id, '# Thread Export' || chr(10) || chr(10) || '## Metadata' || chr(10) || '- Thread ID: ' || thread_id || chr(10) || '- Name: ' || coalesce(name, '(unnamed)') || chr(10) || '- Preview: ' || coalesce({COMPACT.format('preview')}, '(none)')
    || chr(10) || '- Created At: ' || {TIME.format('created_at')} || chr(10) || '- Updated At: ' || {TIME.format('updated_at')} || chr(10) || '- Status: ' || status || chr(10) || '- Cwd: `' || cwd || '`' || chr(10) || '- Source Kind: cli'
    || chr(10) || '- Turns: ' || coalesce(n, 0) || chr(10) || '- Items: ' || items_count || chr(10) || '- Commands: ' || commands_count || chr(10) || '- Files Changed: 0' || chr(10) || chr(10) || '## Turns' || chr(10) || coalesce(body, '- (none)' || chr(10)) || chr(10)
    || '## Commands' || chr(10) || coalesce(commands, '- (none)' || chr(10)) || chr(10) || '## File Changes' || chr(10) || '- (none)' || chr(10) || chr(10) || '## Extracted Notes' || chr(10) || coalesce(notes, '- (none)') AS markdown
  FROM threads LEFT JOIN body USING (thread_id) LEFT JOIN commands USING (thread_id) LEFT JOIN notes USING (thread_id)""")
def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _history(spark, sf_dir)
    return export.markdown(found.threads, found.turns, found.items)


@query("export_prompt_pack", f"""WITH {SAID}, {THREADS}, shown AS (SELECT thread_id, 1 AS list, command AS v, t, line FROM made WHERE kind = 'command_execution'
    UNION ALL SELECT thread_id, 2, {COMPACT.format('output')}, t, line FROM made WHERE kind = 'command_execution' AND regexp_matches(output, '(?i)error|failed|panic|traceback|fatal')
    UNION ALL SELECT thread_id, 3, {COMPACT.format('said_text')}, t, line FROM made WHERE kind IN ('agent_message', 'reasoning_summary')
    UNION ALL SELECT thread_id, 3, 'Turn ' || turn_id || ' is still ' || status, 1000000 + asked_at, 0 FROM turns WHERE status <> 'completed'),
  once AS (SELECT thread_id, list, v, min((t, line)) AS pos FROM shown WHERE v <> '' GROUP BY ALL),
  lists AS (SELECT thread_id, string_agg('- ' || v, chr(10) ORDER BY pos) FILTER (list = 1) AS l1, string_agg('- ' || v, chr(10) ORDER BY pos) FILTER (list = 2) AS l2, string_agg('- ' || v, chr(10) ORDER BY pos) FILTER (list = 3) AS l3 FROM once GROUP BY 1),
  n AS (SELECT thread_id, count(*) AS n FROM turns GROUP BY 1)
  SELECT thread_id, 'OBJECTIVE' || chr(10) || coalesce({COMPACT.format('coalesce(preview, name)')}, '(none)') || chr(10) || chr(10) || 'KEY CONTEXT' || coalesce(chr(10) || '- name: ' || name, '') || chr(10) || '- thread_id: ' || thread_id || chr(10)
    || '- created_at: ' || {TIME.format('created_at')} || chr(10) || '- updated_at: ' || {TIME.format('updated_at')} || chr(10) || '- status: ' || status || chr(10) || '- cwd: ' || cwd || chr(10) || '- source_kind: cli' || chr(10) || '- turns: ' || coalesce(n, 0) || chr(10)
    || '- items: ' || items_count || chr(10) || '- commands: ' || commands_count || chr(10) || '- files_changed: 0' || chr(10) || chr(10) || 'COMMANDS SEEN' || chr(10) || coalesce(l1, '- (none)') || chr(10) || chr(10) || 'FILES TOUCHED' || chr(10) || '- (none)' || chr(10) || chr(10)
    || 'NOTABLE ERRORS' || chr(10) || coalesce(l2, '- (none)') || chr(10) || chr(10) || 'USEFUL FOLLOW-UPS' || chr(10) || coalesce(l3, '- (none)') || chr(10) AS pack
  FROM threads LEFT JOIN lists USING (thread_id) LEFT JOIN n USING (thread_id)""")
def export_prompt_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _history(spark, sf_dir)
    return export.prompt_pack(found.threads, found.turns, found.items)
