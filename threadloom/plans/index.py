"""The full-text index: Parquet tables in numbered versions, built, refreshed, searched and checked.

A version is a folder with the rows of the threads that it indexed: all of them for a build,
new and changed ones for a refresh. Its manifest names every live thread and the version that
holds its rows, so a refresh leaves the rows of other threads where they are, and a build
starts anew. A version also has the state of every log file with its thread, so a refresh
parses only new and changed files and the other files of their threads. ``index_meta`` is written last: a version without it does not exist for readers,
and readers take the newest one that has it. The index can be in any store that Spark reaches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import fold_accents, query_tokens
from threadloom.operators import freshness, ranking
from threadloom.operators.scope import in_scope
from threadloom.sources.logs import History
from threadloom.storage import staged

SCHEMA_VERSION = 3
TABLES = ("threads", "turns", "items", "search_docs", "postings", "lengths")
MANIFEST = "thread_manifest"
LOG_FILES = "log_files"


class IndexMissing(Exception):
    """There is no index, or none that this version reads."""


def item_texts() -> Column:
    """The texts of an item that searches look at, in order."""
    kind, typed = F.col("kind"), F.col("is_typed")
    scalar = lambda x: F.when(F.startswith(x, F.lit('"')), F.try_variant_get(F.try_parse_json(x), "$", "string")).when(~F.rlike(x, F.lit(r"^(\{|\[|null)")), x)
    values = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: scalar(e["value"]))
    texts = (
        F.when(typed & kind.isin("user_message", "agent_message", "reasoning_summary"), F.array("text"))
        .when(typed & (kind == "command_execution"), F.array("command", "output", "cwd"))
        .when(typed & (kind == "file_change"), F.array("path", "summary", "change_type"))
        .when(typed & (kind == "web_search"), F.array("query", "title", "url"))
        .when(typed & (kind == "mcp_tool_call"), F.array("server", "tool", "arguments"))
        .otherwise(values)
    )
    return F.array_compact(F.coalesce(texts, F.array().cast("array<string>")))


def item_title() -> Column:
    kind, typed = F.col("kind"), F.col("is_typed")
    return (
        F.when(~typed, kind).when(kind == "command_execution", F.col("command")).when(kind == "file_change", F.coalesce("path", "summary"))
        .when(kind == "web_search", F.coalesce("title", "query")).when(kind == "mcp_tool_call", F.coalesce("tool", "server"))
    )


def search_documents(history: History) -> DataFrame:
    """Names, previews and items with any text: ``thread_id, turn_id, place, kind, is_typed, title, text, updated_at, cwd``."""
    columns = ["thread_id", "turn_id", "turn_pos", "item_index", "kind", "is_typed", "title", "text"]
    none = {"turn_id": F.lit(None).cast("string"), "item_index": F.lit(0).cast("long"), "is_typed": F.lit(True)}
    headline = lambda column, kind, pos, title: history.threads.where(F.col(column) != "").withColumns(none | {"turn_pos": F.lit(pos).cast("long"), "kind": F.lit(kind), "title": title, "text": F.col(column)}).select(columns)
    found = headline("name", "thread_name", -2, F.col("name")).unionByName(headline("preview", "thread_preview", -1, F.col("name")))
    items = history.items.withColumn("__texts", item_texts()).withColumn("__title", item_title()).where("size(__texts) > 0")
    items = items.withColumn("text", F.array_join("__texts", "\n\n")).withColumn("title", F.col("__title"))
    times = history.threads.select("thread_id", F.coalesce("updated_at", "created_at").alias("updated_at"), "cwd")
    return found.unionByName(items.select(columns)).join(times, "thread_id")


def manifest(history: History) -> DataFrame:
    """``thread_id, last_seen_updated_at, content_fingerprint`` of every thread, its summary and turns included."""
    items = history.items.select("thread_id", F.col("turn_pos").alias("a"), (F.col("item_index") + 1).alias("b"), F.to_json(F.struct("turn_id", "kind", "text", "command", "exit_code", "cwd", "output", "path", "change_type", "summary", "query", "title", "url", "server", "tool", "arguments", F.map_entries("attributes").alias("attributes"))).alias("line"))
    turns = history.turns.select("thread_id", F.col("turn_pos").alias("a"), F.lit(0).cast("long").alias("b"), F.to_json(F.struct("turn_id", "status", "started_at", "completed_at")).alias("line"))
    heads = history.threads.select("thread_id", F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.to_json(F.struct("*")).alias("line"))
    prints = freshness.fingerprints(heads.unionByName(turns).unionByName(items), ["a", "b"], ["line"])
    return history.threads.select("thread_id", F.coalesce("updated_at", "created_at").alias("last_seen_updated_at")).join(prints, "thread_id")


@dataclass
class Index:
    """An index below ``path``."""

    spark: SparkSession
    path: str

    def versions(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/v*/index_meta")
        except AnalysisException:
            return None

    def meta(self) -> dict[str, str]:
        """The newest version's facts; empty if there is no index."""
        rows = self.versions()
        newest = None if rows is None else rows.agg(F.max("version")).first()[0]
        return {} if newest is None else {"version": newest} | {r["key"]: r["value"] for r in rows.where(F.col("version") == newest).collect()}

    def current(self) -> dict[str, str]:
        meta = self.meta()
        if not meta:
            raise IndexMissing(f"no search index at {self.path}; run `index build` first")
        if meta.get("schema_version") != str(SCHEMA_VERSION):
            raise IndexMissing(f"the index at {self.path} has schema version {meta.get('schema_version')}, not {SCHEMA_VERSION}; run `index build`")
        return meta

    def manifest(self, meta: dict[str, str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{meta['version']}/{MANIFEST}")

    def table(self, name: str, meta: dict[str, str] | None = None) -> DataFrame:
        """The live rows of a table: those of versions that are used, of threads that the manifest has there."""
        meta = meta or self.current()
        rows = reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{v}/{name}") for v in meta["versions"].split(",")])
        if meta["whole"] != "true":
            rows = rows.join(self.manifest(meta).select("thread_id", "version"), ["thread_id", "version"], "left_semi")
        return rows.drop("version")

    def files(self, meta: dict[str, str]) -> DataFrame:
        """``path, size, modified, thread_id`` of the log files as they were indexed."""
        return self.spark.read.parquet(f"{self.path}/{meta['version']}/{LOG_FILES}")

    def _next_version(self) -> str:
        """A name after all version folders there are, whatever became of them."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v*")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        names = [re.fullmatch(r"v(\d{10})", f.getPath().getName()) for f in found]
        return f"v{max([int(x[1]) for x in names if x], default=0) + 1:010d}"

    def _write(self, version: str, tables: dict[str, DataFrame], manifest: DataFrame, files: DataFrame, facts: dict[str, str]) -> dict[str, str]:
        for name, rows in tables.items():
            rows = rows.withColumn("version", F.lit(version))
            if name == "postings":
                # Sorted by token, so a search reads the row groups of its tokens only; a frequent token is spread over several files.
                rows = rows.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id")
            out = rows.write.mode("overwrite")
            (out.partitionBy("kind") if name == "search_docs" else out).parquet(f"{self.path}/{version}/{name}")
        manifest.write.mode("overwrite").parquet(f"{self.path}/{version}/{MANIFEST}")
        files.write.mode("overwrite").parquet(f"{self.path}/{version}/{LOG_FILES}")
        facts = facts | {"version": version}
        seen = self.manifest(facts).agg(F.date_format(F.max("last_seen_updated_at"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.count("*")).first()
        size = ranking.corpus(self.table("lengths", facts)).first()
        facts |= {"schema_version": str(SCHEMA_VERSION), "source_backend": "local", "last_manifest_watermark": seen[0] or "", "tracked_thread_count": str(seen[1])}
        facts |= {"n_docs": str(size["n_docs"]), "mean_tokens": repr(size["mean_tokens"] or 0.0)}
        rows = self.spark.createDataFrame([(version, k, v) for k, v in facts.items()], "version string, key string, value string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{version}/index_meta")
        return facts

    def _tables(self, history: History) -> dict[str, DataFrame]:
        docs = search_documents(history)
        order = [F.desc_nulls_last("updated_at"), "thread_id", "turn_pos", "item_index"]
        # Documents are named by their place, so a thread's names do not change when others do.
        # Only narrow rows are numbered.
        key = ["thread_id", "turn_pos", "item_index"]
        number = F.row_number().over(Window.partitionBy("thread_id").orderBy(*order)).cast("string")
        docs = docs.join(docs.select(*key, "updated_at").select(*key, number.alias("n")), key).withColumn("doc_id", F.concat_ws(":", "thread_id", F.coalesce("turn_id", F.lit("-")), "kind", "n")).drop("n")
        docs = staged(docs, "search-docs")
        of = docs.select("doc_id", "thread_id")
        return {
            "threads": history.threads, "turns": history.turns, "items": history.items, "search_docs": docs,
            "postings": ranking.postings(docs, fold_accents).join(of, "doc_id"), "lengths": ranking.lengths(docs, fold_accents).join(of, "doc_id"),
        }

    def _indexed(self, known: DataFrame, version: str) -> DataFrame:
        return known.withColumns({"last_indexed_at": F.current_timestamp(), "source_backend": F.lit("local"), "version": F.lit(version)})

    def build(self, history: History, states: DataFrame | None = None) -> dict[str, str]:
        """Index everything anew; ``states`` (``path, size, modified``) let refreshes tell which files changed since."""
        at, version = datetime.now(UTC).isoformat(timespec="seconds"), self._next_version()
        facts = {"last_build_at": at, "last_refresh_at": at, "versions": version, "whole": "true"}
        meta = self._write(version, self._tables(history), self._indexed(manifest(history), version), self._states(history.files, states), facts)
        return meta | self.counts(meta)

    def _states(self, files: DataFrame, states: DataFrame | None) -> DataFrame:
        """Log files with their threads; without ``states`` none, so that the next refresh parses all."""
        states = states if states is not None else self.spark.createDataFrame([], "path string, size long, modified long")
        return states.join(files.select("path", "thread_id").dropDuplicates(["path"]), "path", "left").select("path", "size", "modified", "thread_id")

    def touched(self, states: DataFrame, parse: Callable[[DataFrame], History]) -> tuple[History, DataFrame]:
        """The history of threads with new, changed or removed files, and all files with their threads.

        ``parse`` folds the files of a ``path`` column. Changed files are parsed together with
        the others of the threads that they belonged to; where they name threads that have
        more files, these are parsed as well.
        """
        known = self.files(self.current())
        states = staged(states, "file-states")
        same = states.join(known, ["path", "size", "modified"], "left_semi").select("path")
        moved = known.join(same, "path", "left_anti").where("thread_id is not null").select("thread_id").distinct()
        here = known.join(states.select("path"), "path", "left_semi")
        paths = staged(states.join(same, "path", "left_anti").select("path").union(here.join(moved, "thread_id", "left_semi").select("path")).distinct(), "touched-files")
        while True:
            history = parse(paths)
            threads = history.files.where("thread_id is not null").select("thread_id").distinct()
            more = here.join(threads, "thread_id", "left_semi").select("path").join(paths, "path", "left_anti")
            if more.isEmpty():
                break
            paths = staged(paths.union(more).distinct(), "touched-files")
        owners = history.files.select("path", "thread_id").unionByName(known.join(paths, "path", "left_anti").select("path", "thread_id"))
        return history, staged(self._states(owners, states), "log-files")

    def refresh(self, history: History, states: DataFrame | None = None, prune: bool = False, whole: bool = True) -> dict[str, str]:
        """Index new and changed threads; the rows of others stay where they are. Threads that are gone stay unless ``prune``.

        Unless ``whole``, ``history`` is the one that ``touched`` found and ``states`` are all files with their threads.
        """
        meta, version = self.current(), self._next_version()
        now, old = staged(manifest(history), "manifest"), self.manifest(meta)
        files = self._states(history.files, states) if whole else states
        classes = freshness.classify(now.select("thread_id", "content_fingerprint"), old)
        if not whole:
            others = files.where("thread_id is not null").select("thread_id").distinct().join(now, "thread_id", "left_anti")
            classes = classes.unionByName(others.select("thread_id", F.lit(None).cast("string").alias("content_fingerprint"), F.lit("unchanged").alias("freshness")))
        counts = {r["freshness"]: r["count"] for r in classes.groupBy("freshness").count().collect()}
        new, changed = counts.get("new", 0), counts.get("changed", 0)
        known = freshness.refreshed(old, self._indexed(now, version).select(old.columns), classes, prune)
        facts = {"last_build_at": meta["last_build_at"], "last_refresh_at": datetime.now(UTC).isoformat(timespec="seconds"), "versions": meta["versions"], "whole": "false"}
        tables: dict[str, DataFrame] = {}
        if new + changed:
            stale = classes.where("freshness <> 'unchanged'").select("thread_id")
            only = lambda x: x.join(stale, "thread_id", "left_semi")
            tables = self._tables(History.of(only(history.threads), only(history.turns), only(history.items), history.files))
            facts["versions"] += f",{version}"
        done = {"new_threads": new, "changed_threads": changed, "unchanged_threads": counts.get("unchanged", 0), "indexed_threads": new + changed}
        return self._write(version, tables, known, files, facts) | {k: str(v) for k, v in done.items()}

    def counts(self, meta: dict[str, str]) -> dict[str, str]:
        """How many live rows each table has."""
        return {name: str(self.table(name, meta).count()) for name in ("threads", "turns", "items", "search_docs")} | {MANIFEST: str(self.manifest(meta).count())}

    def search(self, query: str, limit: int | None = ranking.LIMIT, thinking: bool = False, tools: bool = False, without: DataFrame | None = None) -> DataFrame:
        """Ranked hits: ``thread_id, turn_id, kind, text, score, updated_at, cwd``. ``without``: threads left out."""
        if not query.strip():
            raise ValueError("search query must not be empty")
        meta = self.current()
        docs = self.table("search_docs", meta).where(in_scope(F.col("kind"), thinking, tools) & F.col("is_typed"))
        if without is not None:
            docs = docs.join(without.select("thread_id"), "thread_id", "left_anti")
        words = query_tokens(query)
        folded = self.spark.range(1).select(F.transform(F.array(*map(F.lit, words)), fold_accents).alias("w")).first()["w"] if words else []
        scored = ranking.bm25(self.table("postings", meta), self.table("lengths", meta), folded, (int(meta["n_docs"]), float(meta["mean_tokens"])))
        hits = ranking.rank(docs, scored, query)
        if limit is not None:
            hits = ranking.top(hits, limit, [F.desc("updated_at")])
        return hits.select("thread_id", "turn_id", "kind", "text", "score", "updated_at", "cwd", "heuristic", "bm25", "doc_id")

    def fresh_search(self, query: str, history: History, limit: int = ranking.LIMIT, thinking: bool = False, tools: bool = False) -> DataFrame:
        """Indexed hits of unchanged threads, and hits in the logs of new and changed ones."""
        known = self.manifest(self.current())
        classes = freshness.classify(manifest(history).select("thread_id", "content_fingerprint"), known)
        stale = classes.where("freshness <> 'unchanged'").select("thread_id")
        if stale.isEmpty():
            return self.search(query, limit, thinking, tools)
        columns = ["thread_id", "turn_id", "kind", "text", "score", "updated_at", "cwd"]
        indexed = self.search(query, None, thinking, tools, without=stale).select(columns)
        docs = search_documents(history).where(in_scope(F.col("kind"), thinking, tools) & F.col("is_typed")).join(stale, "thread_id", "left_semi")
        overlaid = ranking.overlay(docs, query).select(columns)
        merged = ranking.merge_hits(indexed, overlaid, ["thread_id", "turn_id", "kind", "text"])
        return merged.orderBy(F.desc("score"), F.desc("updated_at"), "thread_id", F.asc_nulls_first("turn_id"), "kind", "text").limit(limit)

    def doctor(self) -> dict[str, object]:
        """Whether an index exists and is sound, its counts, and what is wrong."""
        meta, issues = self.meta(), []
        if not meta:
            return {"path": self.path, "exists": False, "healthy": False, "schema_version": None, "issues": ["index does not exist"]}
        if meta.get("schema_version") != str(SCHEMA_VERSION):
            issues.append(f"schema version {meta.get('schema_version')} is not {SCHEMA_VERSION}")
        counts: dict[str, str] = {}
        for name in (*TABLES, MANIFEST):
            try:
                counts[name] = str((self.manifest(meta) if name == MANIFEST else self.table(name, meta)).count())
            except (AnalysisException, KeyError):
                issues.append(f"missing table: {name}")
        return {"path": self.path, "exists": True, "healthy": not issues, "schema_version": meta.get("schema_version")} | counts | {"issues": issues}

    def drop(self) -> int:
        """Mark the index as gone; returns how many versions there were. The folder itself stays for its owner to delete."""
        rows = self.versions()
        versions = [] if rows is None else [r[0] for r in rows.select("version").distinct().collect()]
        for version in versions:
            self.spark.createDataFrame([], "version string, key string, value string").write.mode("overwrite").parquet(f"{self.path}/{version}/index_meta")
        return len(versions)
