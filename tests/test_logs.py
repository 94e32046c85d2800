import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from threadloom.operators import fold, merge
from threadloom.plans import export
from threadloom.sources import logs, tables
from threadloom.sources.events import deepened, events
from threadloom.storage import staged


def line(stamp, kind, **payload):
    return json.dumps({"timestamp": f"2026-05-01T{stamp}Z", "type": kind, "payload": payload})


def meta(stamp, name, **more):
    return line(stamp, "session_meta", id=name, timestamp=f"2026-05-01T{stamp}Z", cwd="/work", source={"zeta": 1, "alpha": 2}, **more)


FILES = {
    "a/one.jsonl": [
        meta("08:00:00", "t1", title="First"),
        line("08:00:01", "event_msg", type="task_started", turn_id="u1"),
        line("08:00:02", "response_item", type="message", role="developer", content=[{"type": "input_text", "text": "policy"}]),
        line("08:00:03", "event_msg", type="user_message", turn_id="u1", message="please fix"),
        line("08:00:04", "response_item", type="function_call", name="exec_command", call_id="c1", arguments=json.dumps({"cmd": "make test", "cwd": "/work", "timeout": 5})),
        "", "not json", '{"type": 5}', '{"type":"event_msg","timestamp":"yesterday","payload":{"type":"task_started"}}',
        line("08:00:05", "response_item", type="function_call", name="browse", call_id="c9", arguments="{bad"),
        line("08:00:06", "response_item", type="reasoning", summary=[{"type": "t", "text": "think"}, "more"], encrypted_content="x"),
        line("08:00:07", "event_msg", type="custom", turn_id="u1", note={"b": 1, "a": [2]}),
        line("08:00:08", "response_item", type="function_call", name="shell", call_id="c2", arguments=json.dumps({"command": ["ls", "-l"]})),
        line("08:00:09", "response_item", type="function_call_output", call_id="nobody", output="stray"),
    ],
    "a/two.jsonl": [
        meta("09:00:00", "t1"),
        line("09:00:01", "turn_context", cwd="/work"),
        line("09:00:02", "response_item", type="function_call_output", call_id="c1", output="tests failed"),
        line("09:00:03", "event_msg", type="agent_message", turn_id="u2", message="done"),
        line("09:00:04", "event_msg", type="task_complete"),
    ],
    "b/legacy.jsonl": [
        json.dumps({"type": "thread", "thread_id": "t2", "created_at": "2026-05-01T10:00:00+02:00", "status": "archived"}),
        json.dumps({"type": "turn", "turn_id": "v1", "status": "completed", "started_at": "2026-05-01T08:30:00Z"}),
        json.dumps({"type": "turn", "turn_id": "v1", "status": "again"}),
        json.dumps({"type": "item", "turn_id": "v1", "kind": "command_execution", "command": "false", "exit_code": 3, "output": "panic: no"}),
        json.dumps({"type": "item", "turn_id": "v1", "kind": "command_execution", "command": "x", "exit_code": "3"}),
        json.dumps({"type": "item", "turn_id": "v1", "kind": "file_change", "path": "src/a.rs", "change_type": "modified", "summary": "two\nlines"}),
        json.dumps({"type": "item", "turn_id": "missing", "kind": "user_message", "text": "lost"}),
        json.dumps({"type": "ping", "n": 1}),
    ],
    "b/bare.jsonl": [line("11:00:00", "event_msg", type="task_started", turn_id="w1")],
}


@pytest.fixture(scope="session")
def history(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for name, rows in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("\n".join(rows) + "\n")
    (root / "a/skip.txt").write_text("no log")
    return logs.history(spark, [str(root)]).written()


def test_threads(history):
    rows = {r["thread_id"]: r for r in history.threads.collect()}
    assert rows.keys() == {"t1", "t2"}
    one = rows["t1"]
    assert (one["name"], one["preview"], one["source_kind"], one["status"]) == ("First", "please fix", "alpha", "completed")
    assert str(one["created_at"]), str(one["updated_at"]) == ("2026-05-01 08:00:00", "2026-05-01 09:00:04")
    assert (one["items_count"], one["commands_count"]) == (9, 2)
    assert (rows["t2"]["status"], rows["t2"]["commands_count"], rows["t2"]["files_changed_count"], rows["t2"]["items_count"]) == ("archived", 1, 1, 3)


def test_turns_and_items(history):
    turns = [(r["turn_id"], r["status"]) for r in history.turns.where("thread_id = 't1'").orderBy("turn_pos").collect()]
    assert turns == [("u1", "in_progress"), ("u2", "completed")]  # the second file's unnamed turn takes the name u2
    items = history.items.where("thread_id = 't1'").orderBy("turn_pos", "item_index").collect()
    assert [(r["turn_id"], r["kind"]) for r in items] == [
        ("u1", "user_message"), ("u1", "user_message"), ("u1", "mcp_tool_call"), ("u1", "reasoning_summary"), ("u1", "event:custom"),
        ("u1", "function_call_output"), ("u1", "command_execution"), ("u1", "command_execution"), ("u2", "agent_message"),
    ]
    commands = {r["attributes"]["call_id"]: r for r in items if r["kind"] == "command_execution"}
    assert (commands['"c1"']["command"], commands['"c1"']["output"], commands['"c1"']["attributes"]["timeout"]) == ("make test", "tests failed", "5")
    assert (commands['"c2"']["command"], commands['"c2"']["output"]) == ("ls -l", None)
    assert next(r["text"] for r in items if r["kind"] == "reasoning_summary") == "think\n\nmore"
    assert next(r["arguments"] for r in items if r["kind"] == "mcp_tool_call") == '"{bad"'
    assert next(r["attributes"]["note"] for r in items if r["kind"] == "event:custom") == '{"a":[2],"b":1}'


def test_malformed_lines(history):
    found = {r["path"].rsplit("/", 1)[1]: (r["thread_id"], r["malformed_lines"]) for r in history.files.collect()}
    assert found == {"one.jsonl": ("t1", 3), "two.jsonl": ("t1", 0), "legacy.jsonl": ("t2", 3), "bare.jsonl": (None, 0)}


def test_exports(history):
    pack = {r[0]: r[1] for r in export.prompt_pack(history.threads, history.turns, history.items).collect()}
    assert "NOTABLE ERRORS\n- false exited with code 3\n- panic: no\n\n" in pack["t2"]
    assert "FILES TOUCHED\n- src/a.rs\n" in pack["t2"] and "- Turn u1 is still in_progress" in pack["t1"]
    markdown = {r[0]: r[1] for r in export.markdown(history.threads, history.turns, history.items).collect()}
    assert "- File Change: src/a.rs | modified | two / lines\n" in markdown["t2"]
    assert "\n\n## File Changes\n- (none)\n\n## Extracted Notes\n- think / more\n- done" in markdown["t1"]
    found = {r[0]: json.loads(r[1]) for r in export.details(history.threads, history.turns, history.items).collect()}
    assert found["t2"]["turns"][0]["items"][0] == {"kind": "command_execution", "command": "false", "exit_code": 3, "output": "panic: no"}


def test_no_logs(spark):
    found = logs.history(spark, [])
    assert (found.threads.count(), found.turns.count(), found.items.count()) == (0, 0, 0)


# The window forms against plain sequential models


def promoted(marks):
    """marks: explicit ids or None for an unnamed begin; the turn each stands for."""
    names, seen, current = [], set(), None
    for i, mark in enumerate(marks):
        if mark is None:
            current = f"im{i}"
            names.append(current)
            continue
        if mark not in seen and current is not None and current.startswith("im"):
            names = [mark if n == current else n for n in names]
        seen.add(mark)
        current = mark
        names.append(mark)
    return names


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([None, None, "p", "q", "r"]), max_size=8), min_size=20, max_size=20))
def test_promotion_equals_the_sequential_fold(spark, groups):
    rows = [(g, i, m, f"im{i}") for g, marks in enumerate(groups) for i, m in enumerate(marks)]
    if not rows:
        return
    frame = spark.createDataFrame(rows, "g int, i int, ex string, im string")
    found = {}
    for r in fold.promote(frame, ["g"], ["i"], "ex", "im", "turn").collect():
        found.setdefault(r["g"], {})[r["i"]] = r["turn"]
    for g, marks in enumerate(groups):
        assert [found.get(g, {})[i] for i in range(len(marks))] == promoted([m for m in marks])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([None, None, "p", "q", "r", "-", "-"]), max_size=14), min_size=25, max_size=25), st.sampled_from([1, 2, 3, 50]))
def test_the_fold_by_segments_equals_the_sequential_one(spark, groups, size):
    rows = [(g, i // size, i, m if m not in (None, "-") else None, m is None) for g, marks in enumerate(groups) for i, m in enumerate(marks)]
    frame = spark.createDataFrame(rows, "g int, seg int, i int, claim string, begins boolean")
    frame = fold.first_sights(frame, ["g"], "seg", ["i"], "claim", "first")
    found = {}
    for r in fold.segmented(frame, ["g"], "seg", ["i"], "claim", "begins", F.col("first"), lambda n: F.concat(F.lit("im"), n.cast("string")), "mark", "current").collect():
        found.setdefault(r["g"], {})[r["i"]] = (r["mark"], r["current"])
    for g, marks in enumerate(groups):
        markers = [(i, m) for i, m in enumerate(marks) if m != "-"]
        begun = {f"im{k}": f"im{n}" for n, k in enumerate([k for k, (_, m) in enumerate(markers) if m is None], 1)}
        named = {i: begun.get(name, name) for (i, _), name in zip(markers, promoted([m for _, m in markers]), strict=True)}
        current, wanted = None, {}
        for i in range(len(marks)):
            current = named.get(i, current)
            wanted[i] = (named.get(i), current)
        assert found.get(g, {}) == wanted


def merged_status(shards):
    status = updated = created = None
    for s, u, c in shards:
        if created is None:
            status, updated, created = s, u, c
            continue
        old, new = (updated if updated is not None else created), (u if u is not None else c)
        if (new, c) >= (old, created):
            status = s if s is not None else status
        else:
            status = status if status is not None else s
        updated = u if updated is None else updated if u is None else max(updated, u)
        created = min(created, c)
    return status


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from([None, "x", "y"]), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 5)), min_size=1, max_size=6), min_size=30, max_size=30))
def test_merge_equals_the_sequential_merge(spark, groups):
    rows = [(g, i, *s) for g, shards in enumerate(groups) for i, s in enumerate(shards)]
    frame = spark.createDataFrame(rows, "g int, seq int, status string, updated long, created long")
    found = merge.fresher(frame, ["g"], "seq", "updated", "created").groupBy("g").agg(merge.preferred("status", "seq").alias("s"))
    assert {r["g"]: r["s"] for r in found.collect()} == {g: merged_status(shards) for g, shards in enumerate(groups)}


def test_pairing(spark):
    rows = [(1, "call"), (2, "call"), (3, "out"), (4, "out"), (5, "other"), (6, "call"), (7, "other")]
    frame = spark.createDataFrame([("g", i, k) for i, k in rows], "g string, i int, k string")
    call, out = F.col("k") == "call", F.col("k") == "out"
    assert {r["i"]: r["c"] for r in fold.pair_calls(frame, ["g"], ["i"], call, out, F.col("i"), "c").collect()} == {1: None, 2: None, 3: 2, 4: None, 5: None, 6: None, 7: None}
    assert [r["i"] for r in fold.pending_calls(frame, ["g"], ["i"], call, out, "open").where("open").collect()] == [6]


def test_content_at_any_depth(spark):
    deep = "x"
    for _ in range(40):
        deep = {"content": [{"type": "t", "text": ""}, {"summary": deep}]}
    contents = [[{"content": [{"content": [{"text": "deep"}]}]}], {"content": {"content": {"text": "x"}}}, [deep, "y"], [{"content": [], "summary": [{"text": "s"}]}], {"content": [{"text": 5}]}, [{"text": '"content": ['}, "z"]]
    rows = [meta("08:00:00", "d"), line("08:00:01", "event_msg", type="task_started", turn_id="u")]
    rows += [line("08:00:02", "response_item", type="message", role="assistant", content=c) for c in contents]
    rows += [line("08:00:03", "response_item", type="reasoning", summary=contents[0], content="no"), line("08:00:04", "response_item", type="message", role="assistant", content={"content": {}}, text="own")]
    frame = spark.createDataFrame([(0, "f", (0, i), x) for i, x in enumerate(rows)], "root_no int, path string, line_no struct<block:long,row:long>, raw string")
    items = logs.from_lines(logs.placed(frame)).items.orderBy("item_index").collect()
    assert [r["text"] for r in items] == ["deep", "x", "x\n\ny", "s", None, '"content": [\n\nz', "deep", "own"]


def test_events_are_dealt_out_before_they_become_lines(spark):
    plan = tables.event_logs(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(plan) if "Repartition" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    below = [x for x in plan[at + 1 : next((i for i in range(at + 1, len(plan)) if depth(plan[i]) <= depth(plan[at])), len(plan))]]
    assert below and not any("to_json" in x for x in below)
    narrow = deepened(staged(events(tables.event_logs(spark, SF)), "events")).select("act", "describes")
    assert "Python" not in narrow._jdf.queryExecution().executedPlan().toString()  # only items need their nested texts


def test_made_lines_are_not_made_for_a_filter_too(spark):
    """A filter for blank lines would be pushed below the exchange with all that makes the lines, and they would be made twice."""
    plan = tables.event_logs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert filters and not any("get_json_object" in x or "props" in x for x in filters)


def test_only_claims_are_moved_for_first_sights(spark):
    """Of rows with and without claims each keeps its place and columns; those without one go through no exchange."""
    rows = [("g", 0, 1, "a"), ("g", 0, 2, None), ("g", 1, 3, "a"), ("g", 1, 4, "b"), ("h", 0, 1, "a"), ("h", 0, 2, None)]
    frame = spark.createDataFrame(rows, "g string, seg long, i long, claim string")
    found = fold.first_sights(frame, ["g"], "seg", ["i"], "claim", "first")
    assert found.columns == ["g", "seg", "i", "claim", "first"]
    assert {(r["g"], r["i"]): r["first"] for r in found.collect()} == {("g", 1): True, ("g", 2): False, ("g", 3): False, ("g", 4): True, ("h", 1): True, ("h", 2): False}
    assert found._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")
