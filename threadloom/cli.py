"""The command line: 0 for success, 1 for a failure, 2 for wrong usage; all output is redacted."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import redact
from threadloom.operators.grep import shown_lines
from threadloom.plans.engine import RANK_ORDER, TEXT_ORDER, Engine
from threadloom.session import session
from threadloom.storage import released

VERSION = "threadloom 0.1.0"
ABOUT = {
    "list": ("list", "List threads, the latest update first"),
    "show": ("show [--include-turns] THREAD", "Show a thread, with its turns and items if asked for"),
    "search": ("search [--fresh] [--include-thinking] [--include-tools] [--compact] QUERY", "Ranked search in the index; --fresh looks into changed threads as well"),
    "grep": ("grep [--regex] [--include-thinking] [--include-tools] [--compact] PATTERN", "Search texts for a literal or a regular expression"),
    "export": ("export [--format json|markdown|prompt-pack] THREAD", "Export a thread"),
    "doctor": ("doctor", "Check log folders and count malformed files and lines"),
    "index": ("index build | refresh | doctor | drop [--yes]", "Build, refresh, check or drop the search index"),
}
USAGE = "threadloom [--json | --ndjson] [--backend local|auto] [--root FOLDER]... [--names FILE] [--quiet] [--verbose] [--no-color]"
HELP = "\n".join(["threadloom", "Analytics over local agent-session logs", "", f"Usage: {USAGE} COMMAND", "", *[f"  {usage}" for usage, _ in ABOUT.values()], "", "`threadloom COMMAND --help` tells more."])
COMMANDS = {
    "list": ((), 0), "show": (("--include-turns",), 1), "search": (("--fresh", "--include-thinking", "--include-tools", "--compact"), 1),
    "grep": (("--regex", "--include-thinking", "--include-tools", "--compact"), 1), "export": ((), 1), "doctor": ((), 0), "index": (("--yes",), 1),
}
FORMATS = ("json", "markdown", "prompt-pack")


class UsageError(Exception):
    pass


def parse(args: list[str]) -> dict[str, object]:
    """Options and operands of a command line; options before the command are general ones.

    After ``--``, or where only the operand is missing and the last argument is no known
    option, an argument that starts with a dash is the operand.
    """
    found: dict[str, object] = {"json": False, "ndjson": False, "flags": set(), "format": "json", "operands": [], "roots": [], "names": None, "about": None}
    rest = list(args)
    while rest and rest[0].startswith("-"):
        option = rest.pop(0)
        if option in ("--json", "--ndjson", "--quiet", "--verbose", "--no-color"):
            found[option[2:]] = True
        elif option == "--backend" or option.startswith("--backend="):
            value = option.partition("=")[2] if "=" in option else rest.pop(0) if rest else ""
            if value not in ("local", "auto"):
                raise UsageError(f"unknown backend: {value or '(missing)'}")
        elif option.partition("=")[0] in ("--root", "--names"):
            value = option.partition("=")[2] if "=" in option else rest.pop(0) if rest else ""
            if not value:
                raise UsageError(f"{option} needs a value")
            if option.startswith("--root"):
                found["roots"].append(value)
            else:
                found["names"] = value
        elif option in ("-h", "--help"):
            return found | {"command": "help"}
        elif option in ("-V", "--version"):
            return found | {"command": "version"}
        else:
            raise UsageError(f"unknown option: {option}")
    if found["json"] and found["ndjson"]:
        raise UsageError("--json and --ndjson exclude each other")
    if found.get("quiet") and found.get("verbose"):
        raise UsageError("--quiet and --verbose exclude each other")
    if not rest:
        return found | {"command": "help"}
    command = rest.pop(0)
    if command not in COMMANDS:
        raise UsageError(f"unknown command: {command}")
    flags, wanted = COMMANDS[command]
    operands: list[str] = []
    while rest:
        arg = rest.pop(0)
        last = not rest and len(operands) < wanted
        if arg == "--":
            operands += rest
            break
        if arg in ("-h", "--help") and not last or arg in ("-h", "--help") and command in ("list", "doctor", "index"):
            return found | {"command": "help", "about": command}
        if arg in flags:
            if arg in found["flags"]:
                raise UsageError(f"{arg} is given twice")
            found["flags"].add(arg)
        elif command == "export" and (arg == "--format" or arg.startswith("--format=")):
            value = arg.partition("=")[2] if "=" in arg else rest.pop(0) if rest else ""
            if value not in FORMATS:
                raise UsageError(f"unknown format: {value or '(missing)'}")
            found["format"] = value
        elif arg in ("-h", "--help"):
            return found | {"command": "help", "about": command}
        elif arg.startswith("-") and not last:
            raise UsageError(f"unknown option for {command}: {arg}")
        else:
            operands.append(arg)
    if len(operands) != wanted:
        raise UsageError(f"{command} takes {wanted} operand{'s' * (wanted != 1)}")
    if command == "index" and (operands[0] not in ("build", "refresh", "doctor", "drop") or "--yes" in found["flags"] and operands[0] != "drop"):
        raise UsageError(f"unknown index command: {operands[0]}")
    if command == "export" and found["format"] != "json" and (found["json"] or found["ndjson"]):
        raise UsageError("--json and --ndjson go with the json format only")
    return found | {"command": command, "operands": operands}


HOME = os.path.expanduser("~")


def _redacted(text: str, engine: Engine) -> str:
    return engine.spark.createDataFrame([(text,)], "t string").select(redact.human(F.col("t"), HOME)).first()[0]


def _records(frame: DataFrame, given: dict[str, object], out) -> None:
    """Rows as JSON, without secrets, one after the other: one a line, or an indented array."""
    cells = [redact.secrets(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in frame.dtypes]
    rows: Iterator[str] = (r["j"] for r in frame.select(F.to_json(F.struct(*cells), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"}).alias("j")).toLocalIterator())
    if given["ndjson"]:
        for row in rows:
            print(row, file=out)
        return
    between = "["
    for row in rows:
        print(between + "\n  " + json.dumps(json.loads(row), indent=2, ensure_ascii=False).replace("\n", "\n  "), end="", file=out)
        between = ","
    print("[]" if between == "[" else "\n]", file=out)


def _lines(frame: DataFrame, out) -> None:
    for row in frame.select(redact.human(F.col("line"), HOME).alias("line")).toLocalIterator():
        print(row["line"], file=out)


def _hits(engine: Engine, hits: DataFrame, given: dict[str, object], out, scored: bool) -> None:
    if given["json"] or given["ndjson"]:
        return _records(hits.drop(*TEXT_ORDER, *RANK_ORDER, "heuristic", "bm25", "doc_id"), given, out)
    order = RANK_ORDER if scored else TEXT_ORDER
    if "--compact" in given["flags"]:
        print("| SOURCE | THREAD_ID | THREAD_NAME | CWD | PREVIEW |\n| --- | --- | --- | --- | --- |", file=out)
        return _lines(engine.compact_rows(hits).orderBy(*([] if scored else ["thread_id"]), *order), out)
    lines = shown_lines(hits.withColumn("text", redact.human(F.col("text"), HOME)), engine.shown_threads(HOME), order, scored, scored)
    number = 0
    for row in lines.toLocalIterator():
        head = row["n"] == 0
        number += head
        print(f"{chr(10) * (head and number > 1)}{row['line'].replace('{n}', str(number), 1) if head else row['line']}", file=out)
    return None


def _said(item: dict[str, object]) -> str:
    """What the line of an item shows."""
    kind = item["kind"]
    rules = {
        "user_message": (("text",), "(empty)"), "agent_message": (("text",), "(empty)"), "command_execution": (("command",), "(command execution)"), "file_change": (("path", "summary"), "(file change)"),
        "reasoning_summary": (("text",), "(summary)"), "web_search": (("query", "title"), "(web search)"), "mcp_tool_call": (("tool", "server"), "(mcp tool call)"),
    }
    fields, none = rules.get(kind, ((), f"unknown item {kind}"))
    return next((str(item[f]) for f in fields if item.get(f) is not None), none)


def _report(found: dict[str, object], given: dict[str, object], out) -> None:
    if given["json"] or given["ndjson"]:
        print(json.dumps(found, indent=None if given["ndjson"] else 2), file=out)
        return
    for key, value in found.items():
        if not isinstance(value, list):
            print(f"{key}: {str(value).lower() if isinstance(value, bool) else value}", file=out)
    for root in found.get("roots", []):
        print(f"root [{root['source']}] {root['path']} (exists={str(root['exists']).lower()}, session_files={root['session_files']})", file=out)
    for key, name in (("warnings", "warning"), ("issues", "issue")):
        for value in found.get(key, []):
            print(f"{name}: {value}", file=out)


def run(given: dict[str, object], engine: Engine, out=None) -> None:
    out = out or sys.stdout
    command, flags = given["command"], given["flags"]
    operand = given["operands"][0] if given["operands"] else ""
    scope = {"thinking": "--include-thinking" in flags, "tools": "--include-tools" in flags}
    if command == "list":
        threads = engine.list_threads()
        if given["json"] or given["ndjson"]:
            return _records(threads, given, out)
        return _lines(threads.select(F.concat_ws("\t", "thread_id", F.coalesce("status", F.lit("-")), F.coalesce("name", "preview", F.lit("(unnamed)"))).alias("line")), out)
    if command == "show":
        detail = json.loads(engine.show_thread(operand, "--include-turns" in flags).first()["json"])
        if given["json"] or given["ndjson"]:
            print(json.dumps(detail, indent=None if given["ndjson"] else 2, ensure_ascii=False), file=out)
            return None
        lines = [f"thread_id: {detail['thread_id']}", f"name: {detail.get('name', '(unnamed)')}", f"created_at: {detail['created_at']}", f"items: {detail['items_count']}", f"commands: {detail['commands_count']}", f"files_changed: {detail['files_changed_count']}"]
        lines += [f"cwd: {detail['cwd']}"] * ("cwd" in detail)
        for turn in detail["turns"]:
            lines.append(f"turn {turn['turn_id']} [{turn['status']}]")
            for item in turn["items"]:
                lines.append(f"  - {item['kind']}: {_said(item)}")
        print(_redacted("\n".join(lines), engine), file=out)
        return None
    if command == "grep":
        return _hits(engine, engine.grep(operand, "--regex" in flags, **scope), given, out, False)
    if command == "search":
        hits = engine.search(operand, "--fresh" in flags, **scope)
        return _hits(engine, engine.search_occurrences(hits, operand), given, out, True)
    if command == "export":
        text = engine.export(operand, given["format"])
        if given["format"] == "json":
            print(json.dumps({"format": "json", "thread": json.loads(text)}, indent=None if given["ndjson"] else 2, ensure_ascii=False, separators=(",", ":") if given["ndjson"] else None), file=out)
        else:
            print(_redacted(text, engine), file=out)
        return None
    if command == "doctor":
        return _report(engine.doctor(), given, out)
    if operand == "build":
        return _report({"path": engine.index.path} | engine.build_index(), given, out)
    if operand == "refresh":
        return _report({"path": engine.index.path} | engine.refresh_index(), given, out)
    if operand == "doctor":
        return _report(engine.index.doctor(), given, out)
    if "--yes" not in flags:
        raise ValueError("index drop needs --yes")
    return _report({"path": engine.index.path, "dropped_versions": engine.index.drop()}, given, out)


def _failure(error: Exception, engine: Engine | None) -> str:
    """What a person is told of an error, without secrets and home folders; without a session only its kind."""
    said = str(error).split("JVM stacktrace:")[0].strip() or type(error).__name__
    try:
        return _redacted(said, engine) if engine else type(error).__name__
    except Exception:  # the session itself has failed
        return type(error).__name__


def main(args: list[str] | None = None) -> int:
    try:
        given = parse(sys.argv[1:] if args is None else args)
    except UsageError as error:
        print(f"error: {error}\n`threadloom --help` tells how to use it.", file=sys.stderr)
        return 2
    if given["command"] == "help":
        usage, text = ABOUT.get(given["about"], (None, None))
        print(f"threadloom {given['about']}\n{text}\n\nUsage: {USAGE} {usage}" if usage else HELP)
        return 0
    if given["command"] == "version":
        print(VERSION)
        return 0
    engine = None
    try:
        spark = session()
        engine = Engine(spark, given["roots"] or None, names_path=given["names"])
        with released(spark):
            run(given, engine)
    except Exception as error:
        print(f"error: {_failure(error, engine)}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
