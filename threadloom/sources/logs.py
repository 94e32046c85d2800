"""Session logs: directories of JSONL files folded into frames of threads, turns and items.

A log file is one shard of a thread. Lines are read with Spark's splittable text source and
placed by their block and row, so a large file is read and parsed by many tasks without a
shuffle. Its events are folded in the order of its lines by segments of lines: many tasks fold
one file, and only a short summary of each segment meets those of the others. Shards are then
merged by thread.

Nothing fails on bad input: lines that are no JSON objects, have wrong types or no turn to
belong to are counted as malformed.
"""

from __future__ import annotations

import os
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import has_text
from threadloom.operators import fold, merge
from threadloom.sources.events import ITEM, deepened, events, text_field
from threadloom.storage import staged

ROOT_VARIABLE = "THREADLOOM_HISTORY"
NAMES_VARIABLE = "THREADLOOM_NAMES"
#: Lines of a segment, as a power of two.
SEGMENT_BITS = 13
FILE, LINE = ["root_no", "path"], ["line_no"]
CALL, CALL_ORDER = ["thread_id", "call_id"], ["file_seq", "line_no"]


class History:
    """The frames of a history; ``files`` has one row for each log file with its counts.

    What several frames are made of is written to the shared folder when it is first needed.
    ``threads`` and ``items`` are not; use ``written`` where they are read more than once.
    """

    def __init__(self, rows: DataFrame, names: DataFrame | None = None):
        self._rows, self._names = rows, names

    @classmethod
    def of(cls, threads: DataFrame, turns: DataFrame, items: DataFrame, files: DataFrame) -> History:
        """A history of given frames."""
        found = cls(files)
        found.threads, found.turns, found.items, found.files = threads, turns, items, files
        return found

    @cached_property
    def _shards(self) -> DataFrame:
        return staged(_files(self._rows), "files")

    @cached_property
    def files(self) -> DataFrame:
        return self._shards.select("path", "thread_id", "malformed_lines")

    @cached_property
    def _all_items(self) -> DataFrame:
        return staged(_commands_once(_all_items(self._rows)), "placed-items")

    @cached_property
    def turns(self) -> DataFrame:
        return staged(_turns(self._rows, self._shards, self._all_items), "turns")

    @cached_property
    def items(self) -> DataFrame:
        return _numbered(self._all_items, self.turns)

    @cached_property
    def threads(self) -> DataFrame:
        found = _threads(self._shards, self._all_items)
        return found if self._names is None else merge.back_fill(found, self._names, "thread_id", "name")

    def written(self) -> History:
        """The same history with all its frames in the shared folder."""
        return History.of(staged(self.threads, "threads"), self.turns, staged(self.items, "items"), self.files)


class Root(NamedTuple):
    """A log folder and what named it."""

    source: str
    path: str
    exists: bool


def roots(home: str | None = None) -> list[Root]:
    """The log folders: the one in ``$THREADLOOM_HISTORY``, else the usual ones."""
    given = os.environ.get(ROOT_VARIABLE)
    home = home or os.path.expanduser("~")
    named = [(ROOT_VARIABLE, given)] if given else [(f"default:~/.threadloom/{name}", f"{home}/.threadloom/{name}") for name in ("sessions", "archived_sessions")]
    return [Root(source, path, os.path.exists(path)) for source, path in named]


def names_file(home: str | None = None) -> str | None:
    """The file of session names: the one in ``$THREADLOOM_NAMES``, else the usual one if it is there."""
    usual = os.path.join(home or os.path.expanduser("~"), ".threadloom/session_index.jsonl")
    return os.environ.get(NAMES_VARIABLE) or (usual if os.path.exists(usual) else None)


def log_files(path: str) -> tuple[list[str], list[str]]:
    """What to read for a root, and warnings: of a local one its ``.jsonl`` files, without symbolic links; any other one is itself.

    Warnings name folders and files that cannot be read.
    """
    if "://" in path:
        return [path], []
    if os.path.islink(path):
        return [], []
    if os.path.isfile(path):
        return ([path] if path.endswith(".jsonl") else []), []
    found, warnings = [], []
    for folder, _, names in os.walk(path, onerror=lambda e: warnings.append(f"cannot read directory {e.filename}: {e.strerror}")):
        for name in sorted(names):
            file = os.path.join(folder, name)
            if name.endswith(".jsonl") and not os.path.islink(file):
                if os.access(file, os.R_OK):
                    found.append(file)
                else:
                    warnings.append(f"cannot read {file}")
    return sorted(found), warnings


def file_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, size, modified`` of every log file below the paths; no file is opened."""
    read = None
    for path in paths:
        files, _ = log_files(path)
        if files:
            one = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(files)
            one = one.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.unix_micros("_metadata.file_modification_time").alias("modified"))
            read = one if read is None else read.unionByName(one)
    return (spark.createDataFrame([], "path string, size long, modified long") if read is None else read).dropDuplicates(["path"])


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``root_no, path, file_seq, line_no, segment, raw`` of the lines of all ``.jsonl`` files below the paths, blank ones left out.

    ``line_no`` is a line's place: its block's first byte and its row, which have the order of the lines.
    """
    read = None
    for n, path in enumerate(paths):
        files, _ = log_files(path)
        if files:
            one = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(files)
            at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
            one = one.select(F.lit(n).alias("root_no"), F.col("_metadata.file_path").alias("path"), at.alias("line_no"), F.col("value").alias("raw"))
            read = one if read is None else read.unionByName(one)
    if read is None:
        read = spark.createDataFrame([], "root_no int, path string, line_no struct<block:long,row:long>, raw string")
    return placed(read)


def placed(read: DataFrame) -> DataFrame:
    """Lines (``root_no, path, line_no, raw``) with the order of their file and their segment, blank ones left out."""
    return seated(read.where(has_text(F.col("raw"))))


def seated(read: DataFrame) -> DataFrame:
    """``placed`` for lines of which none is blank; lines that are made are not made once more to see that."""
    seq = F.struct("root_no", F.split("path", "/").alias("parts"))
    segment = F.struct("line_no.block", F.shiftright("line_no.row", SEGMENT_BITS).alias("part"))
    return read.select("root_no", "path", seq.alias("file_seq"), "line_no", segment.alias("segment"), "raw")


# Fold of each file


def folded(rows: DataFrame) -> DataFrame:
    """``events`` with the thread of their file, their turn, whether they count (``ok``), and whether outputs answer a call.

    The fold itself sees narrow rows only; they are joined with their items at the end, by place.
    """
    act, line = F.col("act"), F.col("line_no")
    heads = _heads(rows)
    # An output belongs to the call just before it among the calls and outputs of its id.
    narrow = rows.select(*FILE, "file_seq", "segment", "line_no", "act", "turn_ref", "call_id", "describes").join(heads, FILE, "left")
    called = act.isin("exec", "output")  # never null; only these lines meet by call, the others stay where they are
    calls = fold.pair_calls(narrow.where(called), CALL, CALL_ORDER, act == "exec", act == "output", F.lit(True), "answers").withColumn("answers", F.coalesce("answers", F.lit(False)))
    narrow = calls.unionByName(narrow.where(~called).withColumn("answers", F.lit(False)))
    claims = act.isin("context", "started", "complete", "event", "exec", "tool", "bad_call", "response") | ((act == "output") & ~F.col("answers"))
    claim = F.when((claims | (act == "turn")) & F.col("turn_ref").isNotNull(), F.col("turn_ref"))
    narrow = staged(narrow.withColumn("claim", claim), "claims")

    narrow = fold.first_sights(narrow, FILE, "segment", LINE, "claim", "first")
    again = F.coalesce((act == "turn") & F.col("claim").isNotNull() & ~F.col("first"), F.lit(False))
    narrow = narrow.withColumns({"act": F.when(again, "bad").otherwise(act), "claim": F.when(~again, F.col("claim"))})
    narrow = narrow.withColumn("begins", act.isin("context", "started") & F.col("claim").isNull())
    own_id = lambda number: F.concat_ws(":", F.lit("implicit"), F.left(F.md5(F.col("path").cast("binary")), F.lit(16)), number.cast("string"))
    narrow = fold.segmented(narrow, FILE, "segment", LINE, "claim", "begins", F.col("first") & (act != "turn"), own_id, "mark", "current")
    narrow = _named(rows, narrow.withColumn("turn_id", F.col("current")))
    placed, has_thread = F.col("turn_id").isNotNull(), F.coalesce(F.col("first_meta") <= line, F.lit(False))
    ok = (
        F.when(act.isin("meta", "thread", "turn", "context", "started"), True).when(act.isin("exec", "tool"), placed & has_thread)
        .when(act == "output", F.col("answers") | placed).when(act == "complete", placed)
        .when(act.isin("event", "response", "item", "unknown"), placed & F.col("describes")).otherwise(False)
    )
    found = narrow.select(*FILE, "segment", "line_no", "thread_id", "meta_line", "act", "mark", "current", "turn_id", "answers", ok.alias("ok"))
    return rows.drop("act", "turn_ref", "describes").join(found, [*FILE, "segment", "line_no"])


def _heads(rows: DataFrame) -> DataFrame:
    """The thread of each file that names one, and the first and last lines that do."""
    told = rows.where("summary is not null").groupBy(*FILE)
    return told.agg(F.max_by("summary.thread_id", "line_no").alias("thread_id"), F.max("line_no").alias("meta_line"), F.min("line_no").alias("first_meta"))


def _named(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Legacy items and unknown events that name a turn belong to that one, if it is there already."""
    act = F.col("act")
    named = act.isin("item", "unknown") & F.col("turn_ref").isNotNull()
    if rows.where(named).isEmpty():
        return narrow
    narrow = staged(narrow, "marked")
    marks = narrow.where("mark is not null").groupBy(*FILE, F.col("mark").alias("turn_ref")).agg(F.min("line_no").alias("__there"))
    own = narrow.where(named).join(marks, [*FILE, "turn_ref"], "left")
    own = own.withColumn("turn_id", F.when(F.col("__there") < F.col("line_no"), F.col("turn_ref"))).select(narrow.columns)
    return narrow.where(~F.coalesce(named, F.lit(False))).unionByName(own)


def _files(rows: DataFrame) -> DataFrame:
    """One row for each file: its counts and the summary of its thread."""
    line, act = F.col("line_no"), F.col("act")
    after = line >= F.col("meta_line")
    user = (F.col("item.kind") == "user_message") & F.col("item.is_typed") & F.coalesce(F.col("item.attributes")["role"] == '"user"', F.lit(True)) & (F.col("item.text") != "")
    status = F.when(act == "started", "running").when(act == "complete", "completed").when(F.col("summary").isNotNull(), F.col("summary.status"))
    last = lambda value, where: F.max_by(value, F.when(where, line))
    found = rows.groupBy("root_no", "path", "file_seq").agg(
        F.count_if(~F.col("ok")).alias("malformed_lines"),
        F.max_by("summary", F.when(F.col("summary").isNotNull(), line)).alias("summary"),
        last(F.col("ts"), F.col("ok") & F.col("ts").isNotNull() & after).alias("last_ts"),
        last(status, F.col("ok") & status.isNotNull() & after).alias("last_status"),
        F.min_by("item.text", F.when(F.col("ok") & user & after, line)).alias("first_text"),
    )
    s = F.col("summary")
    return found.select(
        "root_no", "path", "file_seq", "malformed_lines", s["thread_id"].alias("thread_id"), s["name"].alias("name"), F.coalesce(s["preview"], "first_text").alias("preview"), s["created_at"].alias("created_at"),
        F.coalesce("last_ts", s["updated_at"], s["created_at"]).alias("updated_at"), s["cwd"].alias("cwd"), s["source_kind"].alias("source_kind"), s["model_provider"].alias("model_provider"), s["ephemeral"].alias("ephemeral"),
        F.coalesce("last_status", s["status"]).alias("status"),
    )


def _file_turns(rows: DataFrame) -> DataFrame:
    """The turns of each file."""
    line, act = F.col("line_no"), F.col("act")
    timed = act.isin("context", "started", "complete", "event")
    begun = F.coalesce(F.col("legacy_turn.started_at"), F.when(timed, F.col("ts")))
    ended = F.coalesce(F.col("legacy_turn.completed_at"), F.when(act == "complete", F.col("ts")))
    status = F.when(act == "complete", "completed").when(act == "turn", F.col("legacy_turn.status"))
    owned = rows.where("thread_id is not null").withColumn("turn", F.coalesce("mark", F.when(act == "complete", F.col("current")))).where("turn is not null")
    return owned.groupBy("thread_id", "root_no", "path", "file_seq", F.col("turn").alias("turn_id")).agg(
        F.min_by(begun, F.when(F.col("mark").isNotNull() & begun.isNotNull(), line)).alias("started_at"),
        F.max_by(ended, F.when(ended.isNotNull(), line)).alias("completed_at"),
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), line)), F.lit("in_progress")).alias("status"),
        F.min("line_no").alias("first_line"),
    )


def _all_items(rows: DataFrame) -> DataFrame:
    """The items in order of their place; a command stands where its output is, an unanswered one at the end."""
    place = ["thread_id", "turn_id", "file_seq", "line_no", "late"]
    own = rows.where("thread_id is not null and ok")
    columns = [F.col(f"item.{c}").alias(c) for c in ("kind", "is_typed", *ITEM)]
    plain = own.where("item is not null and act <> 'exec' and not answers").withColumn("late", F.lit(0))
    plain = plain.withColumn("item", F.when(F.col("act") == "output", F.col("item").withField("output", F.lit(None).cast("string"))).otherwise(F.col("item")))
    act = F.col("act")
    calls = rows.where((act == "exec") | (act == "output")).select("thread_id", "turn_id", "file_seq", "line_no", "call_id", "act", "answers", "ok", "item")
    rule = CALL, CALL_ORDER, act == "exec", act == "output"
    calls = fold.pending_calls(fold.pair_calls(calls, *rule, F.struct("turn_id", "item"), "call"), *rule, "open_call").where("thread_id is not null and ok")
    answered = calls.where("answers").withColumns({"turn_id": F.col("call.turn_id"), "item": F.col("call.item").withField("output", F.col("item.output")), "late": F.lit(0)}).where("turn_id is not null")
    waiting = calls.where("open_call").withColumn("late", F.lit(1))
    return plain.select(*place, *columns).unionByName(answered.select(*place, *columns)).unionByName(waiting.select(*place, *columns))


def history(spark: SparkSession, paths: list[str], names: DataFrame | None = None, only: DataFrame | None = None) -> History:
    """Fold and merge all logs below the paths, or those of them whose ``path`` ``only`` has; ``names`` (``thread_id, name``) fill names that the logs lack."""
    read = lines(spark, paths)
    if only is not None:
        # The names reach the scan as constants, so other files are not opened.
        read = read.where(F.col("path").isin([r["path"] for r in only.select("path").distinct().toLocalIterator()]))
    return from_lines(read, names)


def from_lines(read: DataFrame, names: DataFrame | None = None) -> History:
    """``history`` of lines that have been read."""
    return History(staged(folded(deepened(staged(events(read), "events"))), "folded-events"), names)


# Merge of each thread's files, in the order of their paths


def _summaries(files: DataFrame) -> DataFrame:
    shards = merge.fresher(files.where("thread_id is not null"), ["thread_id"], "file_seq", _micros("updated_at"), _micros("created_at"))
    kept = ["name", "cwd", "source_kind", "model_provider", "ephemeral", "status"]
    return shards.groupBy("thread_id").agg(
        *[merge.preferred(c, "file_seq").alias(c) for c in kept], merge.first_known("preview", "file_seq").alias("preview"),
        F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
    )


def _threads(files: DataFrame, items: DataFrame) -> DataFrame:
    counts = items.groupBy("thread_id").agg(F.count("*").alias("items_count"), _typed("command_execution").alias("commands_count"), _typed("file_change").alias("files_changed_count"))
    threads = _summaries(files).join(counts, "thread_id", "left").fillna(0, ["items_count", "commands_count", "files_changed_count"])
    return threads.select("thread_id", "name", "preview", "created_at", "updated_at", "cwd", "source_kind", "model_provider", "ephemeral", "status", "items_count", "commands_count", "files_changed_count")


def _turns(rows: DataFrame, files: DataFrame, items: DataFrame) -> DataFrame:
    """The turns of each thread in their order; one that only items name comes last."""
    shards = merge.fresher(_file_turns(rows), ["thread_id", "turn_id"], "file_seq", _micros("completed_at"), _micros("started_at"))
    turns = shards.groupBy("thread_id", "turn_id").agg(
        F.max_by("status", F.when(F.col("is_record"), F.col("file_seq"))).alias("status"), F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"),
        F.min(F.struct("file_seq", "first_line")).alias("first"), F.lit(0).alias("stray"),
    )
    held = items.groupBy("thread_id", "turn_id").agg(F.lit(True).alias("held"))
    turns = turns.join(held, ["thread_id", "turn_id"], "full").withColumns({"status": F.coalesce("status", F.lit("in_progress")), "stray": F.coalesce("stray", F.lit(1))})
    many = F.coalesce(F.col("n_files") > 1, F.lit(False))
    turns = turns.join(files.where("thread_id is not null").groupBy("thread_id").agg(F.count("*").alias("n_files")), "thread_id")
    order = Window.partitionBy("thread_id").orderBy("stray", F.when(many, F.col("started_at")).asc_nulls_first(), F.when(many, F.col("completed_at")).asc_nulls_first(), F.when(many, F.col("turn_id")), "first", "turn_id")
    return turns.select("thread_id", "turn_id", "status", "started_at", "completed_at", (F.row_number().over(order).cast("long") - 1).alias("turn_pos"))


def _numbered(items: DataFrame, turns: DataFrame) -> DataFrame:
    """Items with their number within their turn, and that turn's within its thread."""
    at = Window.partitionBy("thread_id", "turn_id").orderBy("late", "file_seq", "line_no")
    items = items.withColumn("item_index", F.row_number().over(at).cast("long") - 1).join(turns.select("thread_id", "turn_id", "turn_pos"), ["thread_id", "turn_id"])
    return items.select("thread_id", "turn_id", "turn_pos", "item_index", "kind", "is_typed", *ITEM)


def _typed(kind: str) -> Column:
    return F.count_if((F.col("kind") == kind) & F.col("is_typed"))


def _micros(column: str) -> Column:
    return F.unix_micros(column)


def _commands_once(items: DataFrame) -> DataFrame:
    """Commands of a turn with the same call id as one: the first, with its nulls filled from later ones."""
    call = F.when((F.col("kind") == "command_execution") & F.col("is_typed"), F.col("attributes")["call_id"])
    rows = items.withColumn("call", call)
    place = F.struct("late", "file_seq", "line_no")
    filled = ["command", "exit_code", "cwd", "output"]
    alike = rows.where("call is not null").withColumn("place", place).groupBy("thread_id", "turn_id", "call").agg(
        F.min_by(F.struct(*[c for c in items.columns if c not in ("thread_id", "turn_id", *filled, "attributes")]), "place").alias("row"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in filled],
        F.array_sort(F.collect_list(F.struct("place", F.map_entries("attributes").alias("entries")))).alias("all_attributes"),
    )
    first_wins = F.aggregate(
        F.transform("all_attributes", lambda x: F.map_from_entries(x["entries"])), F.create_map().cast("map<string,string>"),
        lambda have, more: F.map_concat(have, F.map_filter(F.coalesce(more, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(have, k))),
    )
    once = alike.select("thread_id", "turn_id", "row.*", *filled, first_wins.alias("attributes"))
    return rows.where("call is null").drop("call").unionByName(once.select(items.columns))


def session_names(spark: SparkSession, path: str) -> DataFrame:
    """``thread_id, name`` of a JSONL file of names: bad lines and blank names skipped, the last line of an id holds."""
    read = spark.read.text(path).withColumn("at", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    rows = read.withColumn("v", F.try_parse_json("value")).selectExpr("at", f"{text_field('v', 'id')} AS thread_id", f"{text_field('v', 'thread_name')} AS name")
    return rows.where("thread_id is not null").where(has_text(F.col("name"))).groupBy("thread_id").agg(F.max_by("name", "at").alias("name"))
