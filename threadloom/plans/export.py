"""Exports of threads: JSON, markdown and a compact hand-off, as one text for each thread.

Turns and items are rendered row by row; one aggregate brings those of a thread together in
their order, and array functions put the lists of its export together. So whole histories are
rendered with one shuffle, and a single thread is just a filter before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import redact
from threadloom.functions.text import compact_text, has_text, rfc3339

# What marks an output as an error.
ERROR_WORDS = "(?i)error|failed|panic|traceback|fatal"


def names_an_error(text: Column) -> Column:
    return F.rlike(text, F.lit(ERROR_WORDS))


def _time(ts: Column) -> Column:
    return rfc3339(ts, "+00:00")


def _given(label: str, value: Column, around: str = "") -> Column:
    """A line of metadata, or null where there is no value."""
    return F.concat(F.lit(f"- {label}: {around}"), value.cast("string"), F.lit(around))


def _item_lines() -> Column:
    """What the turn of an item shows of it."""
    kind, text = F.col("kind"), F.coalesce(compact_text(F.col("text")), F.lit("(none)"))
    own = F.coalesce(F.col("is_typed"), F.lit(True))
    of = lambda name: own & (kind == name)
    change = F.array_join(F.array_compact(F.array("path", "change_type", compact_text(F.col("summary")))), " | ")
    first = (
        F.when(of("user_message"), F.concat(F.lit("- User Message: "), text))
        .when(of("agent_message"), F.concat(F.lit("- Agent Message: "), text))
        .when(of("command_execution"), F.concat(F.lit("- Command: `"), F.coalesce("command", F.lit("(unknown)")), F.lit("`")))
        .when(of("file_change"), F.concat(F.lit("- File Change: "), F.when(change == "", "(unknown)").otherwise(change)))
        .when(of("reasoning_summary"), F.concat(F.lit("- Reasoning Summary: "), text))
        .when(of("web_search"), F.concat(F.lit("- Web Search: "), F.coalesce(compact_text(F.coalesce("query", "title", "url")), F.lit("(none)"))))
        .when(of("mcp_tool_call"), F.concat(F.lit("- MCP Tool Call: "), F.coalesce(compact_text(F.coalesce("tool", "server")), F.lit("(none)"))))
        .otherwise(F.concat(F.lit("- Other Item ("), kind, F.lit("): (preserved)")))
    )
    return _joined(
        first,
        F.when(of("command_execution"), _given("Command Cwd", F.col("cwd"), "`")),
        F.when(of("command_execution"), _given("Command Exit Code", F.col("exit_code"))),
        F.when(of("command_execution"), _given("Command Output", compact_text(F.col("output")))),
    )


def _joined(*lines: Column) -> Column:
    """Lines as one text; null lines are left out."""
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _updated() -> Column:
    return _time(F.coalesce("updated_at", "created_at"))


def _by_thread(threads: DataFrame, turns: DataFrame, items: DataFrame, turn: dict[str, Column], item: dict[str, Column]) -> DataFrame:
    """``threads`` with ``entries``, an array of their turns and items in order, each with the named columns.

    One aggregate brings a thread's entries together; a turn stands before its items. Columns
    that only the other kind of entry has are null.
    """
    at = ["turn_pos", "item_index"]
    heads = turns.select("thread_id", "turn_pos", F.lit(-1).cast("long").alias("item_index"), *[v.alias(k) for k, v in turn.items()])
    rows = heads.unionByName(items.select("thread_id", *at, *[v.alias(k) for k, v in item.items()]), allowMissingColumns=True)
    listed = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct(*at, *[c for c in rows.columns if c not in ("thread_id", *at)]))).alias("entries"))
    none = F.array().cast(listed.schema["entries"].dataType)
    found = threads.join(listed, "thread_id", "left").withColumn("entries", F.coalesce("entries", none))
    return found.withColumn("n_turns", F.size(F.filter("entries", lambda e: e["item_index"] < 0)))


def _every(name: str) -> Column:
    """A column's values that are not null, in the order of the entries."""
    return F.array_compact(F.transform("entries", lambda e: e[name]))


def _list(title: str, lines: Column) -> Column:
    """A titled list of lines, or a word for none."""
    shown = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("- (none)")
    return F.concat(F.lit(f"{title}\n"), shown)


def _once(values: Column) -> Column:
    """Compact values as a list's lines, none empty or twice, by first place."""
    return F.transform(F.array_distinct(F.filter(F.transform(values, compact_text), lambda x: x != "")), lambda x: F.concat(F.lit("- "), x))


def _numbered(name: str, parts: Column) -> Column:
    """Parts with numbered headings, each followed by an empty line."""
    return F.transform(parts, lambda x, i: F.concat(F.lit(f"### {name} "), (i + 1).cast("string"), F.lit("\n"), x, F.lit("\n")))


def markdown(threads: DataFrame, turns: DataFrame, items: DataFrame) -> DataFrame:
    """``thread_id, markdown``: metadata, turns with their items, commands, changed files and notes."""
    of = lambda *kinds: F.col("is_typed") & F.col("kind").isin(*kinds)
    head = _joined(F.concat(F.lit("### "), "turn_id"), _given("Status", F.col("status")), _given("Started At", _time(F.col("started_at"))), _given("Completed At", _time(F.col("completed_at"))))
    item = {
        "line": _item_lines(), "note": F.when(of("agent_message", "reasoning_summary"), F.col("text")),
        "command": F.when(of("command_execution"), _joined(_given("Command", F.coalesce("command", F.lit("(unknown)")), "`"), _given("Cwd", F.col("cwd"), "`"), _given("Exit Code", F.col("exit_code")), _given("Output", compact_text(F.col("output"))))),
        "change": F.when(of("file_change"), _joined(_given("Path", F.col("path"), "`"), _given("Change Type", F.col("change_type")), _given("Summary", compact_text(F.col("summary"))))),
    }
    rows = _by_thread(threads, turns, items, {"head": head}, item)

    # Before a turn's head stands an empty line, and after a head without items a word for none.
    entry, no_item = F.col("entries"), "\n- Item: (none)"
    ends = lambda i: F.coalesce(F.get(entry, i + 1)["item_index"] < 0, F.lit(True))
    shown = F.transform(entry, lambda e, i: F.when(e["head"].isNull(), e["line"]).otherwise(F.concat(F.when(i > 0, "\n").otherwise(""), e["head"], F.when(ends(i), no_item).otherwise(""))))
    text = lambda c, empty: F.coalesce(compact_text(F.col(c)), F.lit(empty))
    metadata = _joined(
        F.lit("# Thread Export\n\n## Metadata"), _given("Thread ID", F.col("thread_id")), _given("Name", text("name", "(unnamed)")), _given("Preview", text("preview", "(none)")),
        _given("Created At", _time(F.col("created_at"))), _given("Updated At", _updated()), _given("Status", F.col("status")), _given("Cwd", F.col("cwd"), "`"), _given("Source Kind", F.col("source_kind")),
        _given("Model Provider", F.col("model_provider")), _given("Ephemeral", F.col("ephemeral")), _given("Turns", F.col("n_turns")), _given("Items", F.col("items_count")),
        _given("Commands", F.col("commands_count")), _given("Files Changed", F.col("files_changed_count")),
    )
    # A list without entries is followed by one empty line, as each entry is.
    section = lambda title, parts: F.concat(F.lit(f"## {title}\n"), F.when(F.size(parts) > 0, F.array_join(parts, "\n")).otherwise("- (none)\n"))
    turn_lines = F.concat(F.lit("## Turns\n"), F.when(F.col("n_turns") > 0, F.array_join(shown, "\n")).otherwise("- (none)"), F.lit("\n"))
    commands, changes = _numbered("Command", _every("command")), _numbered("File Change", _every("change"))
    whole = _joined(F.concat(metadata, F.lit("\n")), turn_lines, section("Commands", commands), section("File Changes", changes), _list("## Extracted Notes", _once(_every("note"))))
    return rows.select("thread_id", whole.alias("markdown"))


def prompt_pack(threads: DataFrame, turns: DataFrame, items: DataFrame) -> DataFrame:
    """``thread_id, pack``: objective, context, commands, files, errors and what is left to do."""
    of = lambda *kinds: F.col("is_typed") & F.col("kind").isin(*kinds)
    command = of("command_execution")
    code = F.when(F.col("exit_code") != 0, F.concat(F.coalesce("command", F.lit("(unknown)")), F.lit(" exited with code "), F.col("exit_code").cast("string")))
    item = {
        "asked": F.when(of("user_message") & has_text(F.col("text")), F.col("text")), "command": F.when(command, F.col("command")), "path": F.when(of("file_change"), F.col("path")),
        "failure": F.when(command, code), "error": F.when(command & names_an_error(F.col("output")), F.col("output")), "note": F.when(of("agent_message", "reasoning_summary"), F.col("text")),
    }
    left = F.when(F.col("status") != "completed", F.concat(F.lit("Turn "), "turn_id", F.lit(" is still "), "status"))
    rows = _by_thread(threads, turns, items, {"left": left}, item)
    objective = F.coalesce(compact_text(F.coalesce(F.get(_every("asked"), F.lit(0)), "preview", "name")), F.lit("(none)"))
    head = _joined(
        F.lit("OBJECTIVE"), objective, F.lit(""), F.lit("KEY CONTEXT"), _given("name", compact_text(F.col("name"))), _given("thread_id", F.col("thread_id")), _given("created_at", _time(F.col("created_at"))),
        _given("updated_at", _updated()), _given("status", F.col("status")), _given("cwd", F.col("cwd")), _given("source_kind", F.col("source_kind")), _given("model_provider", F.col("model_provider")),
        _given("turns", F.col("n_turns")), _given("items", F.col("items_count")), _given("commands", F.col("commands_count")), _given("files_changed", F.col("files_changed_count")),
    )
    errors = F.array_compact(F.flatten(F.transform("entries", lambda e: F.array(e["failure"], e["error"]))))
    lists = {"COMMANDS SEEN": _every("command"), "FILES TOUCHED": _every("path"), "NOTABLE ERRORS": errors, "USEFUL FOLLOW-UPS": F.concat(_every("note"), _every("left"))}
    pack = F.concat_ws("\n\n", head, *[_list(title, _once(values)) for title, values in lists.items()])
    return rows.select("thread_id", F.concat(pack, F.lit("\n")).alias("pack"))


def details(threads: DataFrame, turns: DataFrame, items: DataFrame) -> DataFrame:
    """``thread_id, json``: each thread as one JSON object with its turns and items; nulls are left out."""
    typed = F.map_filter(_typed_cells(), lambda k, v: v.isNotNull())
    open_cells = F.filter(F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.map_contains_key(typed, e["key"]))
    entries = F.array_sort(F.concat(F.map_entries(typed), open_cells))
    fields = F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ",")
    item = F.concat(F.lit('{"kind":'), _quoted(F.col("kind")), F.when(fields != "", F.concat(F.lit(","), fields)).otherwise(""), F.lit("}"))
    by_turn = items.withColumn("line", item).groupBy("thread_id", "turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", "line"))), lambda x: x["line"]), ",").alias("items"))
    head = lambda *pairs: F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs])), ",")
    quoted_time = lambda c: F.concat(F.lit('"'), rfc3339(F.col(c)), F.lit('"'))
    q = lambda c: _quoted(F.col(c))
    one = head(("turn_id", q("turn_id")), ("status", q("status")), ("started_at", quoted_time("started_at")), ("completed_at", quoted_time("completed_at")))
    rows = turns.join(by_turn, ["thread_id", "turn_id"], "left").withColumn("line", F.concat(F.lit("{"), one, F.lit(',"items":['), F.coalesce("items", F.lit("")), F.lit("]}")))
    listed = rows.groupBy("thread_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_pos", "line"))), lambda x: x["line"]), ",").alias("turns"))
    top = head(
        ("thread_id", q("thread_id")), ("name", q("name")), ("preview", q("preview")), ("created_at", quoted_time("created_at")), ("updated_at", quoted_time("updated_at")), ("cwd", q("cwd")),
        ("source_kind", q("source_kind")), ("model_provider", q("model_provider")), ("ephemeral", F.col("ephemeral").cast("string")), ("status", q("status")),
    )
    counts = [F.concat(F.lit(f',"{c}":'), F.col(c).cast("string")) for c in ("items_count", "commands_count", "files_changed_count")]
    return threads.join(listed, "thread_id", "left").select("thread_id", F.concat(F.lit("{"), top, F.lit(',"turns":['), F.coalesce("turns", F.lit("")), F.lit("]"), *counts, F.lit("}")).alias("json"))


def redacted(frame: DataFrame) -> DataFrame:
    """A frame of threads, turns or items with secrets taken out of its texts before they are made JSON.

    Open attributes are JSON texts: those that are strings are read, cleaned and written
    again, values of secret names go, and other ones are cleaned as they stand.
    """

    def cell(key: Column, value: Column) -> Column:
        plain = F.try_variant_get(F.try_parse_json(value), "$", "string")
        own = F.when(F.startswith(value, F.lit('"')), _quoted(redact.secrets(plain))).otherwise(redact.secrets(value))
        return F.when(redact.is_secret_name(key), F.lit(f'"{redact.MARK}"')).otherwise(own)

    kinds = dict(frame.dtypes)
    ids = {"thread_id", "turn_id", "kind", "status"}
    texts = {c: redact.secrets(F.col(c)) for c, t in kinds.items() if t == "string" and c not in ids}
    maps = {c: F.transform_values(F.col(c), cell) for c, t in kinds.items() if t == "map<string,string>"}
    return frame.withColumns(texts | maps)


def _quoted(text: Column) -> Column:
    """Text as a JSON string; null stays null."""
    one = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def _typed_cells() -> Column:
    """The typed fields of an item as JSON texts."""
    plain = ["text", "command", "cwd", "output", "path", "change_type", "summary", "query", "title", "url", "server", "tool"]
    pairs = [x for c in plain for x in (F.lit(c), _quoted(F.col(c)))]
    return F.create_map(*pairs, F.lit("exit_code"), F.col("exit_code").cast("string"), F.lit("arguments"), F.col("arguments"))
