"""Tables brought into the canonical frames of items and search documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.logs import placed, seated

#: Stands in for the kinds of items where documents are searched: a kind for each language.
LANGUAGE_KINDS = {"en": "agent_message", "fr": "user_message", "de": "command_execution", "es": "reasoning_summary"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: one thread each; every role but the assistant's is a user message."""
    kind = F.when(F.col("role") == "assistant", "agent_message").otherwise("user_message")
    rows = load(spark, sf_dir, "conversations")
    return rows.select(F.concat(F.lit("conv_"), "conv_id").alias("thread_id"), F.col("turn").alias("item_index"), kind.alias("kind"), "role", "text")


#: From which row of a conversation on its next question begins the second file of ``conversation_logs``.
LOG_SPLIT = 4
#: Lines that a row can become.
LOG_LINES = 32


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the lines of log files, one or two for each, as ``logs.lines`` gives them.

    A question begins a turn by its id, in every fourth conversation by a context without one;
    there the answer names the turn. An answer is a command and its output, a thought and a
    message, and completes the turn. System rows come before any turn, so they count as malformed;
    every fifth conversation has a line that is no JSON and an output that nobody asked for.
    """
    c, t, text = F.col("conv_id"), F.col("turn"), F.col("text")
    base = F.timestamp_seconds(F.lit(1767225600) + c * 600)  # the year 2026
    stamp = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bare = c % 4 == 1

    def line(kind: str, at: Column, **payload: Column) -> Column:
        return F.to_json(F.struct(stamp(at).alias("timestamp"), F.lit(kind).alias("type"), F.struct(*[v.alias(k) for k, v in payload.items()]).alias("payload")))

    def said(kind: str, n: int, type: str, **payload: Column) -> Column:
        return line(kind, base + F.make_dt_interval(secs=t * 10 + n), type=F.lit(type), **payload)

    call = F.concat(F.lit("k"), t.cast("string"))
    begins = F.when(bare, line("turn_context", base + F.make_dt_interval(secs=t * 10 + 1), cwd=F.lit("/"))).otherwise(said("event_msg", 1, "task_started", turn_id=F.concat(F.lit("t"), t.cast("string"))))
    question = F.array(begins, said("event_msg", 2, "user_message", message=text))
    arguments = F.to_json(F.struct(F.concat(F.lit("run "), t.cast("string")).alias("cmd")))
    answer = F.array(
        said("response_item", 1, "function_call", name=F.lit("exec_command"), call_id=call, arguments=arguments), said("response_item", 2, "function_call_output", call_id=call, output=text),
        said("response_item", 3, "reasoning", summary=F.array(F.struct(F.concat(F.lit("Thought "), t.cast("string")).alias("text")))),
        said("event_msg", 4, "agent_message", turn_id=F.when(bare, F.concat(F.lit("a"), t.cast("string"))), message=text), said("event_msg", 5, "task_complete"),
    )
    policy = F.array(said("response_item", 1, "message", role=F.lit("developer"), content=F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text")))))
    rows = load(spark, sf_dir, "conversations")
    second = rows.where((F.col("role") == "user") & (t >= LOG_SPLIT)).groupBy("conv_id").agg(F.min("turn").alias("second"))
    rows = rows.join(second, "conv_id", "left").withColumn("late", F.coalesce(t >= F.col("second"), F.lit(False)).cast("int"))
    listed = F.when(F.col("role") == "user", question).when(F.col("role") == "assistant", answer).otherwise(policy)
    lines = rows.select("conv_id", "late", F.posexplode(listed).alias("n", "raw"), ((t + 1) * LOG_LINES).alias("at"))
    meta = line("session_meta", base, id=F.concat(F.lit("conv_"), c.cast("string")), timestamp=stamp(base), cwd=F.concat(F.lit("/work/"), (c % 7).cast("string")), source=F.lit("cli"), name=F.when(c % 3 == 0, F.concat(F.lit("Conversation "), c.cast("string"))))
    stray = line("response_item", base, type=F.lit("function_call_output"), call_id=F.lit("nobody"), output=F.lit("stray"))
    heads = F.when(c % 5 == 0, F.array(meta, F.lit("not json"), stray)).otherwise(F.array(meta))
    files = rows.select("conv_id", "late").distinct().select("conv_id", "late", F.posexplode(heads).alias("n", "raw"), F.lit(0).cast("long").alias("at"))
    every = files.unionByName(lines)
    path = F.concat(F.lit("made/"), c.cast("string"), F.lit("-"), F.col("late").cast("string"), F.lit(".jsonl"))
    # Dealt out as many files would be, since few rows become many lines.
    every = every.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return placed(every.select(F.lit(0).alias("root_no"), path.alias("path"), F.struct(F.lit(0).cast("long").alias("block"), (F.col("at") + F.col("n")).alias("row")).alias("line_no"), "raw"))


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of one log file for each user, with the kinds of lines that conversations lack.

    A user's file begins with its thread (a legacy line for every second user), for every third
    user with a legacy turn, and with the turn that all else belongs to. An event then is one of
    ten lines by its id: thoughts, messages, tool calls, legacy items, calls that are never
    answered, and events and items of unknown kinds.
    """
    e, user, k = F.col("event_id"), F.col("user_id").cast("string"), F.get_json_object("props", "$.k").cast("int")
    start = "2026-01-01T00:00:00Z"
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    flat = lambda **fields: F.to_json(F.struct(*[text(v).alias(n) for n, v in fields.items()]))
    line = lambda kind, **payload: flat(timestamp=start, type=kind, payload=F.struct(*[text(v).alias(n) for n, v in payload.items()]))
    said = lambda *parts: F.array(*[F.struct(F.lit("text").alias("type"), text(p).alias("text")) for p in parts])
    word = lambda before, after="": F.concat(F.lit(before), k.cast("string"), F.lit(after))
    call = F.concat(F.lit("c"), e.cast("string"))
    choices = [
        line("event_msg", type="agent_reasoning", text=word("why ")), line("event_msg", type="note", k=k),
        line("response_item", type="message", role="assistant", content=said(F.col("event_type"), word("part "))), line("response_item", type="message", role="user", content=F.col("event_type")),
        line("response_item", type="function_call", name=F.col("event_type"), call_id=call, arguments=word('{"k": ', "}")), line("response_item", type="web_search_call", k=k),
        flat(type="item", turn_id="t", kind="file_change", path=word("src/", ".rs"), k=k), flat(type="ping", turn_id="t", k=k),
        line("response_item", type="function_call", name="shell", call_id=call, arguments=flat(command=F.array(F.lit("run"), k.cast("string"), F.lit("now")))),
        line("response_item", type="reasoning", content=F.array(F.struct(said(word("inner ")).alias("content"))), encrypted_content="x"),
    ]
    # Dealt out while they are narrow, and each event is made into its own line only.
    rows = load(spark, sf_dir, "events").where("event_id >= 0").select("event_id", "user_id", "event_type", "props").repartition(spark.sparkContext.defaultParallelism, "event_id")
    raw = F
    for n, made in enumerate(choices):
        raw = raw.when(e % len(choices) == n, made)
    lines = rows.select("user_id", raw.alias("raw"), (e + 10).alias("row"))
    thread = F.concat(F.lit("user_"), user)
    legacy = flat(type="thread", thread_id=thread, created_at=start, status="archived")
    head = F.when(F.col("user_id") % 2 == 0, legacy).otherwise(line("session_meta", id=thread, timestamp=start))
    old = F.when(F.col("user_id") % 3 == 0, flat(type="turn", turn_id="old", status="completed", started_at=start))
    heads = load(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.posexplode(F.array_compact(F.array(head, old, line("event_msg", type="task_started", turn_id="t")))).alias("row", "raw"))
    every = lines.unionByName(heads.select("user_id", "raw", F.col("row").cast("long").alias("row")))
    return seated(every.select(F.lit(0).alias("root_no"), F.concat(F.lit("made/u"), user, F.lit(".jsonl")).alias("path"), F.struct(F.lit(0).cast("long").alias("block"), "row").alias("line_no"), "raw"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search documents, with the source as title and a kind for each language."""
    kind = F.lit("other")
    for lang, name in LANGUAGE_KINDS.items():
        kind = F.when(F.col("lang") == lang, name).otherwise(kind)
    rows = load(spark, sf_dir, "documents")
    return rows.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("thread_id"), kind.alias("kind"), F.col("source").alias("title"), "text")
