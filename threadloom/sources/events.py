"""Decoding of log lines: each JSON line becomes one row that says what it does and which item it describes.

A line is parsed once, and its own fields and those of its payload become maps: one of the
fields that are texts, one list of those that are neither texts nor null. All rules then
look names up in these maps, so the plan stays small whatever kinds of lines there are. An
item's columns are each one choice by what the line is (``what``).

Lines that are no JSON objects, have duplicate keys or wrong types become ``bad``.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXEC_TOOLS = ("exec_command", "shell")
TYPED_KINDS = ("user_message", "agent_message", "command_execution", "file_change", "reasoning_summary", "web_search", "mcp_tool_call")
_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
FIELDS = "map<string,variant>"
#: The columns of an item after its kind; all but two are texts.
ITEM = ["text", "command", "exit_code", "cwd", "output", "path", "change_type", "summary", "query", "title", "url", "server", "tool", "arguments", "attributes"]


# Values, as SQL: an expression is one text, so a plan of many rules is made with few calls


def _is(v: str, *kinds: str) -> str:
    return f"schema_of_variant({v}) IN ({', '.join(map(repr, kinds))})"


def _get(v: str, kind: str) -> str:
    return f"try_variant_get({v}, '$', '{kind}')"


def _texts(fields: str) -> str:
    """The fields that are texts."""
    return f"transform_values(map_filter({fields}, (k, x) -> {_is('x', 'STRING')}), (k, x) -> {_get('x', 'string')})"


def _odd(fields: str) -> str:
    """Names of the fields that are neither texts nor null."""
    return f"map_keys(map_filter({fields}, (k, x) -> NOT {_is('x', 'STRING', 'VOID')}))"


def _time(text: str) -> str:
    return f"CASE WHEN {text} RLIKE r'{_RFC3339}' THEN try_cast(translate({text}, 'tz', 'TZ') AS timestamp) END"


def _string(v: str) -> str:
    """A variant's text that is not empty."""
    return f"nullif(CASE WHEN {_is(v, 'STRING')} THEN {_get(v, 'string')} END, '')"


def text_field(v: str, key: str) -> str:
    """A field's text, if it is one."""
    own = f"try_variant_get({v}, '$.{key}', 'variant')"
    return f"CASE WHEN {_is(own, 'STRING')} THEN {_get(own, 'string')} END"


def _content(v: str) -> str:
    """The text in message content: a text, an object's text, content or summary, or the parts of an array.

    Content within content is looked into where it is a text; see ``deepened`` for all else.
    """
    inner = lambda x: ", ".join(_string(f"try_variant_get({x}, '$.{key}', 'variant')") for key in ("text", "content", "summary"))
    parts = f"array_compact(transform({_get(v, 'array<variant>')}, x -> coalesce({_string('x')}, {inner('x')})))"
    return f"coalesce({_string(v)}, nullif(array_join({parts}, '\n\n'), ''), {inner(v)})"


def _nested(v: str) -> str:
    """The JSON of content that holds content or a summary of its own; null for any other, which ``_content`` reads."""
    return rf"""CASE WHEN to_json({v}) RLIKE r'"(?:content|summary)"\s*:\s*[\[{{]' THEN to_json({v}) END"""


def _words(v: str) -> str:
    """An array of texts joined by spaces; null for anything else."""
    parts = _get(v, "array<variant>")
    return f"CASE WHEN size({parts}) > 0 AND forall({parts}, x -> {_is('x', 'STRING')}) THEN array_join(transform({parts}, x -> {_get('x', 'string')}), ' ') END"


def _content_text(found: object) -> str | None:
    """``_content`` at any depth."""
    if isinstance(found, str):
        return found or None
    if isinstance(found, list):
        parts = [text for x in found if isinstance(x, str | dict) and (text := _content_text(x))]
        return "\n\n".join(parts) if parts else None
    if isinstance(found, dict):
        own = found.get("text")
        return own if isinstance(own, str) and own else _content_text(found.get("content")) or _content_text(found.get("summary"))
    return None


def _deep_texts(content: pd.Series) -> pd.Series:
    sys.setrecursionlimit(max(10_000, sys.getrecursionlimit()))
    return content.map(lambda x: None if x is None else _content_text(json.loads(x)))


def deepened(rows: DataFrame) -> DataFrame:
    """Staged ``events`` with the texts of content that nests further: only these rows, if there are any, go through Arrow batches."""
    if rows.where("deep is not null").isEmpty():
        return rows.drop("deep")
    return rows.where("deep is null").drop("deep").unionByName(_deepened(rows.where("deep is not null")))


def _deepened(rows: DataFrame) -> DataFrame:
    d, read = F.col("deep"), F.pandas_udf(_deep_texts, "string")
    content, shown = (F.coalesce(read(d[c]), d[f"plain_{c}"]) for c in ("content", "shown"))
    text = F.when(d["thought"], F.coalesce(shown, content, d["text"])).otherwise(F.coalesce(content, d["text"]))
    return rows.withColumn("item", F.col("item").withField("text", text)).drop("deep")


# Lines


def _named(columns: dict[str, str]) -> list[str]:
    return [f"{value} AS `{name}`" for name, value in columns.items()]


def _struct(columns: dict[str, str]) -> str:
    return f"struct({', '.join(_named(columns))})"


def events(raw: DataFrame) -> DataFrame:
    """Each line's event: what it does (``act``), times, ids and the item that it may become."""
    place = [c for c in raw.columns if c != "raw"]
    rows = raw.selectExpr(*place, "CASE WHEN is_valid_utf8(raw) THEN try_parse_json(raw) END AS v")
    rows = rows.selectExpr(*place, f"{_get('v', FIELDS)} AS line", f"try_variant_get(v, '$.payload', '{FIELDS}') AS payload")
    rows = rows.selectExpr(*place, "line", "payload", "map_filter(line, (k, x) -> k <> 'payload') AS bare")
    rows = rows.selectExpr(*place, "line", "payload", "bare", *_named({"l": _texts("bare"), "p": _texts("payload")}))
    rows = rows.selectExpr("*", *_named({"ts": _time("l.timestamp")}))
    rows = rows.selectExpr(*place, "line", "payload", "l", "p", "ts", *_named({"act": _act()}))
    held = {"said": "CASE WHEN act = 'response' THEN payload.content END", "summed": "CASE WHEN act = 'response' THEN payload.summary END"}
    parsed = f"CASE WHEN act = 'exec' THEN try_variant_get(try_parse_json(p.arguments), '$', '{FIELDS}') END"
    rows = rows.selectExpr("*", *_named({"what": _WHAT, "parsed": parsed} | held))
    rows = rows.selectExpr("*", *_named({"content": _content("said"), "shown": _content("summed")}))
    turn_ref = "CASE WHEN act IN ('turn', 'item', 'unknown') THEN l.turn_id ELSE p.turn_id END"
    turn = _struct({"status": "l.status", "started_at": _time("l.started_at"), "completed_at": _time("l.completed_at")})
    found = {"turn_ref": turn_ref, "describes": "what IS NOT NULL", "summary": _summary(), "item": _item(), "deep": _deep(), "call_id": "p.call_id", "legacy_turn": f"CASE WHEN act = 'turn' THEN {turn} END"}
    return rows.selectExpr(*place, "act", "ts", *_named(found))


def _act() -> str:
    texts = lambda odd, *keys: f"NOT arrays_overlap({odd}, array({', '.join(map(repr, keys))}))"
    lo, po = _odd("bare"), _odd("payload")  # written out, so that only the kinds of lines that ask for them pay for them
    sealed = f"CASE WHEN l.timestamp IS NOT NULL THEN ts IS NOT NULL ELSE {texts(lo, 'timestamp')} END"
    meta = f"{sealed} AND p.id IS NOT NULL AND {_time('p.timestamp')} IS NOT NULL AND {texts(po, 'name', 'title', 'cwd', 'originator', 'model_provider')}"
    thread = f"l.thread_id IS NOT NULL AND {_time('l.created_at')} IS NOT NULL AND {texts(lo, 'name', 'preview', 'cwd', 'source_kind', 'model_provider', 'status')}"
    whole = f"(line.exit_code IS NULL OR {_is('line.exit_code', 'VOID')} OR ({_is('line.exit_code', 'BIGINT', 'INT')} AND {_get('line.exit_code', 'int')} IS NOT NULL))"
    item = f"l.turn_id IS NOT NULL AND l.kind IS NOT NULL AND (l.kind <> 'command_execution' OR {whole})"
    tools = ", ".join(map(repr, EXEC_TOOLS))
    return f"""CASE l.type
      WHEN 'session_meta' THEN CASE WHEN {meta} THEN 'meta' ELSE 'bad' END
      WHEN 'thread' THEN CASE WHEN {thread} THEN 'thread' ELSE 'bad' END
      WHEN 'turn' THEN CASE WHEN l.turn_id IS NOT NULL AND l.status IS NOT NULL THEN 'turn' ELSE 'bad' END
      WHEN 'item' THEN CASE WHEN {item} THEN 'item' ELSE 'bad' END
      WHEN 'turn_context' THEN CASE WHEN {sealed} AND payload IS NOT NULL THEN 'context' ELSE 'bad' END
      WHEN 'event_msg' THEN CASE WHEN NOT coalesce({sealed} AND p.type IS NOT NULL, false) THEN 'bad' WHEN p.type = 'task_started' THEN 'started' WHEN p.type = 'task_complete' THEN 'complete' ELSE 'event' END
      WHEN 'response_item' THEN CASE WHEN NOT coalesce({sealed} AND p.type IS NOT NULL, false) THEN 'bad'
        WHEN p.type = 'function_call' THEN CASE WHEN p.name IN ({tools}) AND p.call_id IS NOT NULL THEN 'exec' WHEN p.name NOT IN ({tools}) THEN 'tool' ELSE 'bad_call' END
        WHEN p.type = 'function_call_output' THEN CASE WHEN p.call_id IS NOT NULL THEN 'output' ELSE 'bad' END ELSE 'response' END
      ELSE CASE WHEN l.type IS NULL THEN 'bad' ELSE 'unknown' END END"""


#: Which item a line describes: a choice among those of ``_item``; null for none.
_WHAT = f"""CASE
  WHEN act = 'event' THEN CASE WHEN p.type IN ('user_message', 'agent_message') THEN CASE WHEN p.message IS NOT NULL THEN p.type END
    WHEN p.type = 'agent_reasoning' THEN CASE WHEN p.text IS NOT NULL THEN p.type END ELSE 'other' END
  WHEN act IN ('exec', 'tool', 'output', 'unknown') THEN act
  WHEN act = 'response' THEN CASE WHEN p.type IN ('message', 'reasoning') THEN p.type ELSE 'other' END
  WHEN act = 'item' THEN CASE WHEN l.kind IN {TYPED_KINDS} THEN 'legacy' ELSE 'legacy_other' END END"""

#: Which fields do not stay as open attributes, since they have a column; ``type`` and ``turn_id`` for all others.
_WITHOUT = {
    "exec": ["cmd", "command", "cwd", "call_id"],
    "tool": ["type", "name", "arguments"],
    "message": ["type", "turn_id", "content", "text"],
    "reasoning": ["type", "turn_id", "summary", "content", "text", "encrypted_content"],
    "legacy": ["type", "turn_id", "kind", *ITEM[:-1]],
    "legacy_other": ["type", "turn_id", "kind"],
}


def _kept() -> str:
    """The fields of a line that stay as open attributes of its item; each kind of line looks for its own names only."""
    own = lambda name: f"(k, x) -> k NOT IN ({', '.join(map(repr, _WITHOUT.get(name, ['type', 'turn_id'])))})"
    call = "map_filter(coalesce(payload, line), (k, x) -> k = 'call_id')"
    fields = {"tool": "payload", "message": "payload", "reasoning": "payload", "legacy": "line", "legacy_other": "line", "unknown": "line"}
    choices = " ".join(f"WHEN '{name}' THEN map_filter({held}, {own(name)})" for name, held in fields.items())
    return f"CASE what WHEN 'exec' THEN map_concat(map_filter(coalesce(parsed, map_filter(payload, (k, x) -> false)), {own('exec')}), {call}) {choices} ELSE map_filter(payload, {own('')}) END"


def _item() -> str:
    """The item that a line describes, with null where its kind has no such field."""
    own = lambda k: f"CASE WHEN {_is(f'parsed.{k}', 'STRING')} THEN {_get(f'parsed.{k}', 'string')} END"
    command = f"coalesce({own('cmd')}, CASE WHEN parsed.cmd IS NULL THEN coalesce({own('command')}, {_words('parsed.command')}) END, {_words('parsed.argv')}, {_words('parsed.args')})"
    arguments = r"CASE WHEN p.arguments IS NOT NULL THEN coalesce(to_json(try_parse_json(p.arguments)), regexp_extract(to_json(array(p.arguments)), r'(?s)^\[(.*)\]$', 1)) END"
    kind = """CASE what WHEN 'message' THEN CASE WHEN p.role = 'assistant' THEN 'agent_message' ELSE 'user_message' END WHEN 'legacy' THEN l.kind WHEN 'legacy_other' THEN l.kind WHEN 'unknown' THEN concat('event:', l.type)
      WHEN 'other' THEN CASE WHEN act = 'event' THEN concat('event:', p.type) ELSE p.type END WHEN 'exec' THEN 'command_execution' WHEN 'tool' THEN 'mcp_tool_call' WHEN 'output' THEN 'function_call_output'
      WHEN 'agent_reasoning' THEN 'reasoning_summary' WHEN 'reasoning' THEN 'reasoning_summary' ELSE what END"""
    special = {
        "text": "WHEN 'user_message' THEN p.message WHEN 'agent_message' THEN p.message WHEN 'agent_reasoning' THEN p.text WHEN 'message' THEN coalesce(content, p.text) WHEN 'reasoning' THEN coalesce(shown, content, p.text)",
        "command": f"WHEN 'exec' THEN CASE WHEN parsed IS NOT NULL THEN {command} ELSE coalesce(p.arguments, '') END",
        "cwd": f"WHEN 'exec' THEN {own('cwd')}",
        "output": "WHEN 'output' THEN p.output",
        "tool": "WHEN 'tool' THEN p.name",
    }
    columns = {c: f"CASE what {special.get(c, '')} WHEN 'legacy' THEN l.{c} END" for c in ITEM} | {
        "exit_code": f"CASE WHEN what = 'legacy' THEN {_get('line.exit_code', 'int')} END",
        "arguments": f"CASE what WHEN 'tool' THEN {arguments} WHEN 'legacy' THEN to_json(line.arguments) END",
        "attributes": f"CASE WHEN what NOT IN ('user_message', 'agent_message', 'agent_reasoning') THEN transform_values({_kept()}, (k, x) -> coalesce(to_json(x), 'null')) END",
    }
    typed = "what NOT IN ('other', 'output', 'legacy_other', 'unknown')"
    return f"CASE WHEN what IS NOT NULL THEN {_struct({'kind': kind, 'is_typed': typed} | columns)} END"


def _deep() -> str:
    held = {"content": _nested("said"), "shown": _nested("summed"), "plain_content": "content", "plain_shown": "shown", "text": "p.text", "thought": "what = 'reasoning'"}
    return f"CASE WHEN what IN ('message', 'reasoning') AND coalesce({held['content']}, {held['shown']}) IS NOT NULL THEN {_struct(held)} END"


def _summary() -> str:
    """What a line says of its thread."""
    source = f"coalesce(p.source, array_min(map_keys({_get('payload.source', FIELDS)})), p.originator)"
    either = lambda meta, thread: f"CASE act WHEN 'meta' THEN {meta} ELSE {thread} END"
    columns = {
        "thread_id": either("p.id", "l.thread_id"), "name": either("coalesce(p.name, p.title)", "l.name"), "preview": either("NULL", "l.preview"),
        "created_at": either(_time("p.timestamp"), _time("l.created_at")), "updated_at": either(f"coalesce(ts, {_time('p.timestamp')})", _time("l.updated_at")), "cwd": either("p.cwd", "l.cwd"),
        "source_kind": either(source, "l.source_kind"), "model_provider": either("p.model_provider", "l.model_provider"),
        "ephemeral": either("NULL", _get("line.ephemeral", "boolean")), "status": either("'running'", "l.status"),
    }
    return f"CASE WHEN act IN ('meta', 'thread') THEN {_struct(columns)} END"
