import io
import json

import pytest

from tests.test_logs import FILES, line, meta
from threadloom import cli
from threadloom.plans.engine import Engine, ThreadMissing
from threadloom.plans.index import IndexMissing
from threadloom.sources import logs
from threadloom.streaming.refresh import refresh_available


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("history")
    for name, rows in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text("\n".join(rows) + "\n")
    (root / "names").write_text('{"id": "t2", "thread_name": "Old"}\nbad\n{"id": "t2", "thread_name": "Second"}\n{"id": "t2", "thread_name": " "}\n')
    return root


@pytest.fixture(scope="module")
def engine(spark, root):
    return Engine(spark, [str(root)], str(root / "index"), str(root / "names"))


def shown(engine, *args):
    out = io.StringIO()
    cli.run(cli.parse(list(args)), engine, out)
    return out.getvalue()


def test_list_show_and_doctor(engine):
    assert [r["thread_id"] for r in engine.list_threads().collect()] == ["t1", "t2"]
    assert {r["thread_id"]: r["name"] for r in engine.history.threads.collect()} == {"t1": "First", "t2": "Second"}
    detail = json.loads(shown(engine, "--json", "show", "t1"))
    assert (detail["turns"], detail["items_count"]) == ([], 9)
    assert "turn u1 [in_progress]" in shown(engine, "show", "--include-turns", "t1")
    with pytest.raises(ThreadMissing):
        engine.show_thread("t9")
    assert f"root [option] {engine.roots[0].path} (exists=true, session_files=4)" in shown(engine, "doctor")
    found = engine.doctor()
    assert (found["parsed_threads"], found["malformed_files"], found["malformed_lines"]) == (2, 3, 6)
    assert len(found["warnings"]) == 1 and "missing valid thread metadata" in found["warnings"][0]


def test_grep(engine):
    hits = [(r["thread_id"], r["turn_id"], r["kind"], r["text"]) for r in engine.grep("ls", tools=True).collect()]
    assert hits == [("t1", "u1", "command_execution", "ls -l"), ("t2", "v1", "command_execution", "false")]
    assert engine.grep("test").count() == 0 and engine.grep("tests? fail", regex=True, tools=True).count() == 1
    assert engine.grep("").count() == 3  # every message
    out = shown(engine, "grep", "--compact", "please")
    assert out.splitlines()[2] == "| user | t1 | First | /work | please fix |"
    assert "1. thread_id: t1\n   name: First\n   cwd: /work\n   hits: 1\n   occurrences: 1\n   matched in: user" in shown(engine, "grep", "please")


def test_index_lifecycle(spark, engine, root):
    with pytest.raises(IndexMissing):
        engine.search("please").collect()
    assert engine.index.doctor()["exists"] is False
    built = engine.index.build(engine.history)
    assert (built["threads"], built["search_docs"]) == ("2", "14")
    assert [r["text"] for r in engine.search("FIX please").collect()] == ["please fix"]
    assert engine.search("plea").count() == 0 and engine.search("?").count() == 0
    with pytest.raises(ValueError, match="empty"):
        engine.search("  ")
    same = engine.index.refresh(engine.history)
    assert (same["new_threads"], same["changed_threads"], same["unchanged_threads"], same["indexed_threads"]) == ("0", "0", "2", "0")

    extra = root / "c/new.jsonl"
    extra.parent.mkdir()
    extra.write_text("\n".join([meta("12:00:00", "t3"), line("12:00:01", "event_msg", type="user_message", turn_id="x", message="please help ok, café")]) + "\n")
    with (root / "a/two.jsonl").open("a") as more:
        more.write(line("09:10:00", "event_msg", type="agent_message", turn_id="u2", message="help ok again") + "\n")
    now = Engine(spark, [str(root)], str(root / "index"), str(root / "names"))
    assert now.search("help ok").count() == 0
    fresh = [(r["thread_id"], r["score"]) for r in now.search("help ok", fresh=True).collect()]
    assert fresh == [("t3", 1002.0), ("t1", 1002.0)]
    done = now.index.refresh(now.history)
    assert (done["new_threads"], done["changed_threads"], done["unchanged_threads"], done["tracked_thread_count"]) == ("1", "1", "1", "3")
    assert {r["thread_id"] for r in now.search("help ok").collect()} == {"t1", "t3"}
    assert now.search("cafe").count() == 1  # accents do not matter
    assert now.index.doctor()["healthy"] is True
    assert "best score:" in shown(now, "search", "help ok")

    extra.unlink()
    gone = Engine(spark, [str(root)], str(root / "index"))
    gone.index.refresh(gone.history)
    assert gone.search("cafe").count() == 1  # threads that are gone stay
    gone.index.refresh(gone.history, prune=True)
    assert gone.search("cafe").count() == 0
    assert shown(gone, "index", "drop", "--yes").startswith("path:") and gone.index.doctor()["exists"] is False
    # An index can be built again after it was dropped, as often as one likes.
    for _ in range(2):
        gone.index.build(gone.history)
        assert gone.search("please").count() == 1 and gone.index.doctor()["healthy"] is True
        gone.index.drop()
        with pytest.raises(IndexMissing):
            gone.search("please")


def test_refresh_leaves_other_threads_where_they_are(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write = lambda name, *said: (logs / f"{name}.jsonl").write_text("\n".join([meta("08:00:00", name), *[line(f"08:00:{i + 1:02}", "event_msg", type="user_message", turn_id="u", message=x) for i, x in enumerate(said)]]) + "\n")
    make = lambda: Engine(spark, [str(logs)], str(tmp_path / "index"))
    found = lambda words: sorted((r["thread_id"], round(r["score"], 6)) for r in make().search(words).collect())
    write("a", "first words"), write("b", "other words")
    make().index.build(make().history)
    write("b", "other words", "more words"), write("c", "late words")
    done = make().index.refresh(make().history)
    assert (done["new_threads"], done["changed_threads"], done["unchanged_threads"], done["versions"]) == ("1", "1", "1", "v0000000001,v0000000002")
    assert [r["thread_id"] for r in spark.read.parquet(str(tmp_path / "index/v0000000002/threads")).orderBy("thread_id").collect()] == ["b", "c"]
    after = found("words")
    assert [t for t, _ in after] == ["a", "b", "b", "c"]
    counts = make().index.counts(make().index.current())
    make().index.build(make().history)
    assert found("words") == after and make().index.counts(make().index.current()) == counts


def test_refresh_parses_what_changed(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    said = lambda name, *words: "\n".join([meta("08:00:00", name), *[line(f"08:00:{i + 1:02}", "event_msg", type="user_message", turn_id="u", message=x) for i, x in enumerate(words)]]) + "\n"
    for i in range(40):
        (logs / f"{i:02}.jsonl").write_text(said(f"t{i}", f"word{i} here"))
    make = lambda: Engine(spark, [str(logs)], str(tmp_path / "index"))
    counts = lambda done: tuple(int(done[k]) for k in ("parsed_files", "new_threads", "changed_threads", "unchanged_threads", "tracked_thread_count"))
    found = lambda words: sorted(r["thread_id"] for r in make().search(words).collect())
    assert make().build_index()["parsed_files"] == "40"
    # One file is edited, a further shard brings the other file of its thread, and one thread is new.
    with (logs / "07.jsonl").open("a") as more:
        more.write(line("09:00:00", "event_msg", type="user_message", turn_id="u", message="edited now") + "\n")
    (logs / "zz.jsonl").write_text(said("t3", "second shard"))
    (logs / "new é 1.jsonl").write_text(said("n", "brand new"))
    assert counts(make().refresh_index()) == (4, 1, 2, 38, 41)
    assert found("edited") == ["t7"] and found("shard") == ["t3"] == found("word3") and found("brand") == ["n"]
    # A thread that loses a shard changes; one that is gone is pruned if asked for.
    (logs / "zz.jsonl").unlink()
    (logs / "05.jsonl").unlink()
    assert counts(make().refresh_index(prune=True)) == (1, 0, 1, 39, 40) and found("shard") == [] == found("word5")
    assert counts(make().refresh_index()) == (0, 0, 0, 40, 40)
    assert make().index.doctor()["healthy"] is True


def test_exports_are_redacted(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join([meta("08:00:00", "s"), line("08:00:01", "event_msg", type="user_message", turn_id="u", message="a\napi_key=plainsecret123456 in /home/ann/x")]))
    own = Engine(spark, [str(tmp_path)], str(tmp_path / "index"))
    for form in ("markdown", "prompt-pack", "json"):
        out = shown(own, "export", "--format", form, "s")
        assert "plainsecret" not in out and ("/home/ann" in out) == (form == "json")
    assert json.loads(shown(own, "--ndjson", "export", "s"))["format"] == "json"


@pytest.mark.parametrize("args", [["--json", "--ndjson", "list"], ["nope"], ["show"], ["list", "x"], ["grep", "--fresh", "x"], ["grep", "--regex", "--regex", "x"], ["--backend", "far", "list"], ["export", "--format", "pdf", "t"], ["--json", "export", "--format", "markdown", "t"], ["index", "burn"], ["--wat", "list"], ["index", "build", "--yes"]])
def test_wrong_usage(args):
    with pytest.raises(cli.UsageError):
        cli.parse(args)
    assert cli.main(args) == 2


def test_help_of_commands_and_errors(spark, root, tmp_path, monkeypatch, capsys):
    assert cli.main(["grep", "--help"]) == 0 and "grep [--regex]" in capsys.readouterr().out
    monkeypatch.setattr(cli, "HOME", str(tmp_path))
    monkeypatch.setenv("THREADLOOM_INDEX", str(tmp_path / "index"))
    (tmp_path / "index").mkdir()
    assert cli.main(["--root", str(root), "--names", str(root / "names"), "list"]) == 0 and "Second" in capsys.readouterr().out
    assert cli.main(["--root", str(root), "search", "x"]) == 1 and capsys.readouterr().err.startswith("error: no search index at ~/index")
    assert cli.main(["--root", str(root), "grep", "--regex", "x{2,1}"]) == 1 and "error: " in capsys.readouterr().err
    assert cli.main(["--root", str(root), "--names", str(tmp_path / "none"), "list"]) == 1 and "Traceback" not in capsys.readouterr().err


def test_heads_of_grouped_hits(spark, tmp_path):
    said = lambda text: line("08:00:01", "event_msg", type="user_message", turn_id="u", message=text)
    (tmp_path / "a.jsonl").write_text("\n".join([meta("08:00:00", "a"), said("Clean up the\n leftover argv"), line("08:00:02", "event_msg", type="agent_message", message="the leftover argv is gone")]))
    (tmp_path / "b.jsonl").write_text("\n".join([line("08:00:00", "session_meta", id="b", timestamp="2026-05-01T08:00:00Z", name=" \t"), "\t \t", said("x" * 170 + " leftover argv")]))
    out = shown(Engine(spark, [str(tmp_path)], str(tmp_path / "index")), "grep", "leftover argv")
    assert "1. thread_id: a\n   first prompt: Clean up the leftover argv\n   cwd: /work\n   hits: 2\n   occurrences: 4\n   matched in: user, assistant\n" in out
    assert f"2. thread_id: b\n   first prompt: {'x' * 160}...\n   hits: 1\n   occurrences: 2\n" in out


def test_a_session_that_fails_to_start_is_no_traceback(monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: 1 / 0)
    assert cli.main(["list"]) == 1 and capsys.readouterr().err == "error: ZeroDivisionError\n"


def test_links_are_not_followed(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "own.jsonl").write_text(meta("08:00:00", "s") + "\n")
    (tmp_path / "logs/link.jsonl").symlink_to(tmp_path / "own.jsonl")
    assert logs.log_files(str(tmp_path / "logs")) == ([], [])
    assert logs.log_files(str(tmp_path)) == ([str(tmp_path / "own.jsonl")], [])
    assert Engine(spark, [str(tmp_path / "logs")], str(tmp_path / "index")).doctor()["parsed_threads"] == 0


def test_item_lines():
    said = [({"kind": "user_message"}, "(empty)"), ({"kind": "command_execution", "command": "ls", "text": "x"}, "ls"), ({"kind": "file_change", "summary": "s"}, "s"), ({"kind": "web_search", "title": "t", "query": "q"}, "q"), ({"kind": "mcp_tool_call", "server": "s"}, "s"), ({"kind": "event:x", "text": "t"}, "unknown item event:x")]
    assert [cli._said(item) for item, _ in said] == [text for _, text in said]


def test_usage():
    assert cli.parse(["grep", "--", "--regex"])["operands"] == ["--regex"]
    assert cli.parse(["grep", "-v"])["operands"] == ["-v"]
    assert cli.parse(["--backend=auto", "search", "--fresh", "q"])["flags"] == {"--fresh"}
    assert cli.parse(["--help"])["command"] == "help" and cli.parse([])["command"] == "help"
    assert cli.main(["--version"]) == 0


def test_stream_refreshes_once_for_new_files(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "one.jsonl").write_text(meta("08:00:00", "s") + "\n" + line("08:00:01", "event_msg", type="user_message", turn_id="u", message="first words") + "\n")
    make = lambda: Engine(spark, [str(logs)], str(tmp_path / "index"))
    run = lambda: refresh_available(spark, str(logs), str(tmp_path / "checkpoint"), make)
    assert run() == 1 and make().search("first").count() == 1
    assert run() == 0
    (logs / "two.jsonl").write_text(meta("09:00:00", "z") + "\n" + line("09:00:01", "event_msg", type="user_message", turn_id="u", message="second words") + "\n")
    assert run() == 1 and make().search("words").count() == 2
