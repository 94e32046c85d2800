"""All commands as methods that return frames: list, show, grep, search, export, doctor and the index."""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import redact
from threadloom.functions.text import compact_preview, term_count
from threadloom.operators import grep as greps
from threadloom.plans import export
from threadloom.plans.index import Index, item_texts
from threadloom.sources import logs
from threadloom.storage import staged

INDEX_VARIABLE = "THREADLOOM_INDEX"
#: Where texts are in the order of a history, and hits of a search in theirs.
TEXT_ORDER, RANK_ORDER = ["turn_pos", "item_index", "nth"], ["rank"]


class ThreadMissing(Exception):
    """There is no thread of this id."""


class Engine:
    """Commands over the logs below ``paths`` (else the usual folders), the index at ``index_path`` and the names in ``names_path``."""

    def __init__(self, spark: SparkSession, paths: list[str] | None = None, index_path: str | None = None, names_path: str | None = None):
        self.spark = spark
        self.roots = [logs.Root("option", p, os.path.exists(p) or "://" in p) for p in paths] if paths else logs.roots()
        self.names_path = names_path or logs.names_file()
        self.index = Index(spark, index_path or os.environ.get(INDEX_VARIABLE) or os.path.expanduser("~/.threadloom/index"))

    @property
    def _paths(self) -> list[str]:
        return [x.path for x in self.roots if x.exists]

    def _names(self) -> DataFrame | None:
        return logs.session_names(self.spark, self.names_path) if self.names_path else None

    @cached_property
    def history(self) -> logs.History:
        return logs.history(self.spark, self._paths, self._names()).written()

    def _states(self) -> DataFrame:
        """The log files as they are."""
        return logs.file_states(self.spark, self._paths)

    def build_index(self) -> dict[str, str]:
        """Index everything anew."""
        states = staged(self._states(), "file-states")  # as they are before they are parsed
        return self.index.build(self.history, states) | {"parsed_files": str(self.history.files.count())}

    def refresh_index(self, prune: bool = False) -> dict[str, str]:
        """Index what changed; only new and changed files, and the others of their threads, are parsed.

        Names that come from another file can change threads whose logs did not; where there is
        such a file, all is parsed.
        """
        states = staged(self._states(), "file-states")
        if self.names_path:
            return self.index.refresh(self.history, states, prune) | {"parsed_files": str(self.history.files.count())}
        found, files = self.index.touched(states, lambda only: logs.history(self.spark, self._paths, None, only).written())
        return self.index.refresh(found, files, prune, whole=False) | {"parsed_files": str(found.files.count())}

    def list_threads(self) -> DataFrame:
        """Summaries, the latest update first."""
        return self.history.threads.orderBy(F.desc_nulls_last("updated_at"), F.desc("created_at"), F.desc("thread_id"))

    def _one(self, frame: DataFrame, thread_id: str) -> DataFrame:
        return frame.where(F.col("thread_id") == thread_id)

    def show_thread(self, thread_id: str, include_turns: bool = False) -> DataFrame:
        """The thread as one row with its JSON; counts hold also without the turns."""
        threads = self._one(self.history.threads, thread_id)
        if threads.isEmpty():
            raise ThreadMissing(f"thread not found: {thread_id}")
        none = F.lit(False)
        turns, items = (self._one(x, thread_id) if include_turns else x.where(none) for x in (self.history.turns, self.history.items))
        return threads.join(export.details(*map(export.redacted, (threads, turns, items))), "thread_id")

    def grep(self, pattern: str, regex: bool = False, thinking: bool = False, tools: bool = False) -> DataFrame:
        """Each text in scope that matches, in order: ``thread_id, turn_id, kind, text, occurrences, ordinal``."""
        texts = self.history.items.where("is_typed").select("thread_id", "turn_id", "turn_pos", "item_index", "kind", F.posexplode(item_texts()).alias("nth", "text"))
        found = greps.grep(texts, pattern, regex, thinking, tools)
        return found.orderBy("thread_id", *TEXT_ORDER).select("thread_id", "turn_id", "kind", "text", "occurrences", *TEXT_ORDER)

    def search(self, query: str, fresh: bool = False, thinking: bool = False, tools: bool = False, limit: int = 50) -> DataFrame:
        """Ranked hits of the index; ``fresh`` looks into threads that changed since as well."""
        if fresh:
            return self.index.fresh_search(query, self.history, limit, thinking, tools)
        return self.index.search(query, limit, thinking, tools)

    def search_occurrences(self, hits: DataFrame, query: str) -> DataFrame:
        """The hits of a search, which are limited in number, with their ``rank`` and how often they hold its words."""
        ranked = hits.coalesce(1).withColumn("rank", F.monotonically_increasing_id())
        return ranked.withColumn("occurrences", term_count(F.col("text"), query))

    def shown_threads(self, home: str | None = None) -> DataFrame:
        """Name, preview and folder of each thread as a person is shown them."""
        shown = {"name": F.col("name"), "preview": compact_preview(F.col("preview")), "cwd": F.col("cwd")}
        return self.history.threads.select("thread_id", *[redact.human(x, home).alias(c) for c, x in shown.items()])

    def compact_rows(self, hits: DataFrame) -> DataFrame:
        """Hits as rows of a markdown table, with their thread's name or preview and folder."""
        return greps.table_rows(hits, self.history.threads)

    def export(self, thread_id: str, form: str = "json") -> str:
        """One thread as json (without secrets), markdown or prompt-pack."""
        threads, turns, items = (self._one(x, thread_id) for x in (self.history.threads, self.history.turns, self.history.items))
        if form == "json":
            threads, turns, items = map(export.redacted, (threads, turns, items))
        render = {"json": export.details, "markdown": export.markdown, "prompt-pack": export.prompt_pack}[form]
        row = render(threads, turns, items).first()
        if row is None:
            raise ThreadMissing(f"thread not found: {thread_id}")
        return row[1]

    def doctor(self) -> dict[str, object]:
        """Counts of roots, threads, and malformed files and lines, with warnings."""
        row = self.history.files.agg(
            F.count_distinct("thread_id").alias("parsed_threads"),
            F.count_if(F.col("thread_id").isNull() | (F.col("malformed_lines") > 0)).alias("malformed_files"),
            F.coalesce(F.sum("malformed_lines"), F.lit(0)).alias("malformed_lines"),
        ).first()
        bare = self.history.files.where("thread_id is null").orderBy("path").select("path")
        listed = {x.path: logs.log_files(x.path) for x in self.roots}
        roots = [{"source": x.source, "path": x.path, "exists": x.exists, "session_files": len(listed[x.path][0])} for x in self.roots]
        warnings = [w for _, found in listed.values() for w in found]
        warnings += [f"{r['path']}: missing valid thread metadata" for r in bare.toLocalIterator()]
        return {"roots": roots} | row.asDict() | {"warnings": warnings}
