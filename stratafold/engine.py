"""The stages over one configuration: scan, duplicates, similarity, plan, report, waste, largest.

Tables are snapshots (``SnapshotStore``); a stage that has seen the latest run is not
repeated unless asked.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable
from itertools import chain
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import paths
from stratafold.functions.hashing import hash_files, is_current
from stratafold.operators import clusters as C
from stratafold.operators import duplicates, legacy, similarity, snapshot, tree, waste
from stratafold.plans import artifacts, proposals, xlsx
from stratafold.scratch import materialize
from stratafold.sources import walk
from stratafold.sources.config import ScanConfig

FOLDERS = "path string, parent string, depth int, mtime double, file_count long, total_bytes long, run_id long, is_missing boolean, scanned_at double"
FILES = "folder string, filename string, path string, size long, mtime double, ctime double, run_id long, is_missing boolean"
HASHES = "path string, quick_hash string, full_hash string, size long, mtime double"
STATE = "stage string, run_id long"
ROOTS = "root string, run_id long, total_folders long, total_files long, indexed_folders long, indexed_files long, last_scanned_at timestamp"
ERRORS = "kind string, path string, message string"
CANDIDATES = "folder_a string, folder_b string, score double, shared_duplicate_files long, shared_signatures long, name_bonus double, size_ratio double, file_count_ratio double, reason string"
ANALYSED = "path string, analysed_at double"
RESULTS = "folder_a string, folder_b string, jaccard double, shared long"
MATCHES = "folder_a string, folder_b string, filename string, size long, jaccard double, path_a string, path_b string, quick_match boolean, full_match boolean"
GROUPS = "full_hash string, size_bytes long, file_count long, total_bytes long"

#: Fixed values of the space estimate: bytes of tables per file, mean file size, shares of free space.
ROW_BYTES, MEAN_FILE, ABORT_SHARE, WARN_SHARE = 400, 50_000, 0.90, 0.50
#: Fixed value: free bytes below which a scan ends early.
LEAST_FREE = 500 * 1024 * 1024


def space_check(used: list[int], free: int) -> tuple[str, int, int]:
    """('ok', 'warn' or 'abort', estimated files, estimated bytes) for roots that use so many bytes."""
    files = sum(u // MEAN_FILE for u in used)
    share = files * ROW_BYTES / max(free, 1)
    return ("abort" if share >= ABORT_SHARE else "warn" if share >= WARN_SHARE else "ok"), files, files * ROW_BYTES


class Engine:
    def __init__(self, spark: SparkSession, config: ScanConfig, notice: Callable[[str], None] = lambda text: None):
        """``notice`` is told how far a scan is and what could not be read."""
        self.spark, self.config, self.notice = spark, config, notice
        store = lambda name, **more: snapshot.SnapshotStore(spark, f"{config.database}/{name}", **more)
        # Files, folders and hashes are joined by path again and again.
        self.stores = {n: store(n, buckets=config.table_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))) for n in ("folders", "files", "hashes")}
        self.stores |= {n: store(n) for n in ("groups", "candidates", "errors", "older_analysed", "older_results", "older_matches")} | {"state": store("state", key="stage"), "roots": store("roots", key="root")}

    def _read(self, name: str, schema: str) -> DataFrame:
        """The newest snapshot, with the columns of the schema that an older one lacks; empty if there is none."""
        rows = self.stores[name].get()
        if rows is None:
            return self.spark.createDataFrame([], schema)
        wanted = {c.split()[0]: (c.split()[1], None) for c in schema.split(", ")}
        return snapshot.with_columns(rows, wanted).select(*wanted)

    def _state(self) -> dict[str, int]:
        return {r["stage"]: r["run_id"] for r in self._read("state", STATE).collect()}

    def _set(self, stage: str, run: int) -> None:
        self.stores["state"].upsert(self.spark.createDataFrame([(stage, run)], STATE))

    def active_files(self) -> DataFrame:
        return self._read("files", FILES).filter("not is_missing")

    def active_folders(self) -> DataFrame:
        return self._read("folders", FOLDERS).filter("not is_missing")

    def preflight(self) -> str:
        """Output folders must be writable; returns the verdict of the space check."""
        for folder in (self.config.database, self.config.home, os.path.dirname(self.config.report)):
            Path(folder).mkdir(parents=True, exist_ok=True)
            if not os.access(folder, os.W_OK):
                raise PermissionError(folder)
        used = [shutil.disk_usage(r).used for r in self.config.roots if os.path.isdir(r)]
        verdict, _, size = space_check(used, shutil.disk_usage(self.config.database).free)
        if verdict == "abort":
            raise RuntimeError(f"the tables may take {size} bytes, more than is free")
        return verdict

    def _enough_space(self, level: int, done: int, folders: int) -> str | None:
        """Says how far the scan is, and a reason to end it where space runs out."""
        self.notice(f"level {level}: {done:,} of {folders:,} folders")
        free = shutil.disk_usage(self.config.database).free
        return f"the scan ended early, {free >> 20} MB are free; what was listed is kept" if free < LEAST_FREE else None

    def scan(self, rescan: bool = False, delta: bool = False) -> int:
        """Lists the roots, replaces what changed and marks what is gone; returns the run.

        Roots listed before are left out unless asked for; a delta scan reads only folders
        that changed since they were read. What could not be read is kept in the table of
        errors and said once.
        """
        Path(self.config.database).mkdir(parents=True, exist_ok=True)
        state, seen = self._state(), self._read("roots", ROOTS)
        known = {r["root"] for r in seen.select("root").collect()}
        roots = [r for r in self.config.roots if os.path.isdir(r) and (rescan or delta or r not in known)]
        if not roots:
            return state.get("scan", 0)
        run = max(snapshot.next_run(seen), state.get("scan", 0) + 1)
        read_at = self.active_folders().select("path", F.col("scanned_at").alias("last_scan")) if delta and not rescan else None
        stopped = None
        try:
            listing = walk.walk(self.spark, roots, self.config.exclude_folders, read_at=read_at, before_batch=self._enough_space)
        except walk.Stopped as e:
            listing, stopped = e.listing, e
        dirs, files = walk.inventory(listing, self.config.exclude_extensions, self.config.min_file_size, self.config.max_file_size)
        self._keep(dirs, files, listing, run, [] if stopped else roots)
        errors = tree.distinct_errors(listing.filter("kind = 'error'").select(F.col("what").alias("kind"), "path", "message", "code"))
        self.stores["errors"].write(errors.select("kind", "path", "message"))
        for r in self._read("errors", ERRORS).orderBy("path").toLocalIterator():
            self.notice(f"{r['kind']} not read: {r['path']}: {r['message']}")
        if stopped:
            raise stopped
        fresh = snapshot.root_stats(listing, files, run).withColumn("last_scanned_at", F.current_timestamp())
        self.stores["roots"].upsert(fresh)
        self._set("scan", run)
        return run

    def _keep(self, dirs: DataFrame, files: DataFrame, listing: DataFrame, run: int, whole_roots: list[str]) -> None:
        """The next versions of folders and files; under ``whole_roots`` what this run did not meet is gone.

        Only rows that changed are written. That all others were met is one entry per whole
        root (``seen``); after a walk that was ended early the rows it met carry the run.
        """
        known = self._read("folders", FOLDERS).select("path").unionByName(dirs.select("path"))
        if not snapshot.reject_unknown(files, known).isEmpty():
            raise ValueError("files were listed in folders that are not known")
        mark = lambda df: df.withColumn("run_id", F.lit(run).cast("long")).withColumn("is_missing", F.lit(False))
        dirs = mark(dirs).withColumn("scanned_at", F.unix_micros(F.current_timestamp()) / 1e6)
        unchanged = listing.filter("kind = 'unchanged'").select(F.col("path").alias("folder"))
        seen = {root: run for root in whole_roots}
        for name, rows, schema, folder in (("folders", dirs, FOLDERS, "path"), ("files", mark(files), FILES, "folder")):
            columns = [x.split()[0] for x in schema.split(", ")]
            old, rows = self._read(name, schema).select(*columns), rows.select(*columns)
            met = rows.select("path")
            fresh = snapshot.changed(rows, old, "path", ("run_id",)) if whole_roots else rows
            active = old.filter("not is_missing").join(met, "path", "left_anti")
            if whole_roots:
                below = F.lit(False)
                for root in whole_roots:
                    below = below | paths.under(F.col("path"), F.lit(root))
                rest = active.filter(below).join(unchanged.select(F.col("folder").alias(folder)), folder, "left_anti").withColumn("is_missing", F.lit(True))
            else:
                rest = active.join(unchanged.select(F.col("folder").alias(folder)), folder, "left_semi").withColumn("run_id", F.lit(run).cast("long"))
            self.stores[name].upsert(fresh.unionByName(rest.select(*columns)), seen)

    def scan_stats(self) -> DataFrame:
        """What each root held when it was last scanned, in all and indexed."""
        return self._read("roots", ROOTS).orderBy("root")

    def stale_roots(self) -> DataFrame:
        roots = self.spark.createDataFrame([(r,) for r in self.config.roots], "root string")
        return snapshot.stale_roots(roots, self._read("roots", ROOTS), F.current_timestamp(), self.config.scan_max_age_days)

    def duplicates(self, rescan: bool = False) -> DataFrame:
        state = self._state()
        if rescan or not state.get("duplicates", 0) >= state.get("scan", 0) > 0:
            files = self.active_files()
            # A hash is known only for the size and time it was made at.
            known = self._read("hashes", HASHES).filter(is_current(F.col("size"), F.col("full_hash"))).join(files.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
            hashed = duplicates.funnel(files, lambda f: hash_files(f, "quick"), lambda f: hash_files(f, "full"), self.config.duplicate_size_threshold, known)
            self.stores["hashes"].write(hashed.join(files.select("path", "size", "mtime"), "path"))
            rows = files.join(self._read("hashes", HASHES).select("path", "full_hash"), "path")
            self.stores["groups"].write(duplicates.groups(rows, self.config.duplicate_size_threshold, "full_hash"))
            self._set("duplicates", state.get("scan", 0))
        return self._read("groups", GROUPS)

    def hashed_files(self) -> DataFrame:
        """The active files with their full hashes, where known."""
        return self.active_files().join(self._read("hashes", HASHES).select("path", "full_hash"), "path", "left")

    def similarity(self, rescan: bool = False) -> DataFrame:
        state = self._state()
        if rescan or min(state.get("duplicates", 0), state.get("similarity", 0)) < state.get("scan", 0):
            files = self.hashed_files().withColumnRenamed("full_hash", "h")
            keys = similarity.folder_keys(files, self.config.duplicate_size_threshold).join(self.active_folders().select(F.col("path").alias("folder")), "folder", "left_semi")
            keys = materialize(similarity.merged_keys(materialize(keys, "keys")), "merged")
            scored = similarity.scores(
                similarity.candidate_pairs(keys), keys, tree.subtree_totals(files), self.config.similarity_threshold, tokens=self.config.backup_name_tokens
            )
            self.stores["candidates"].write(scored)
            self._set("similarity", state.get("scan", 0))
        return self._read("candidates", CANDIDATES)

    def clusters(self) -> dict[str, DataFrame]:
        """The clusters with their members and unique files, as the tables of a plan."""
        pairs = self._tracked().filter("track = 'cluster'")
        members = C.clusters(pairs)
        mastered = C.masters(members, self.active_folders(), self.config.roots)
        return artifacts.plan_tables(mastered, C.least_scores(members, pairs), C.suppressed(members), C.unique_files(mastered, self.hashed_files()))

    def _tracked(self) -> DataFrame:
        return similarity.tracks(self._read("candidates", CANDIDATES), self.config.merge_threshold, self.config.similarity_cluster_threshold)

    def plan(self, replan: bool = False) -> Path:
        state = self._state()
        last = artifacts.latest(self.config.home, "plan")
        if last and not replan and artifacts.is_current(artifacts.header(last), state.get("scan", 0), state.get("similarity", 0)):
            return last
        path = artifacts.write_plan(self.config.home, proposals.outside_clusters(self._tracked()), self.clusters(), state.get("scan", 0), state.get("similarity", 0))
        self._set("plan", state.get("scan", 0))
        return path

    def waste(self) -> DataFrame:
        """Waste folders that still exist, measured on files that still exist; what has changed below them is written back."""
        found = materialize(waste.candidates(self.active_files()).select("path"), "waste")
        roots = materialize(found.mapInPandas(_there, "root string, exists boolean"), "roots")
        live = walk.below(roots.filter("exists").select(F.col("root").alias("path"))).filter("kind = 'file'").select("path", "size", "mtime")
        old = self._read("files", FILES)
        self._write_back(snapshot.refresh_subtrees(old.filter("not is_missing"), roots, live), old)
        return waste.candidates(self.active_files(), self.config.waste_file_size).join(found, "path", "left_semi").orderBy(F.desc("size_bytes"), "path")

    def largest(self) -> DataFrame:
        """Large files that still exist, by size; each root has its own threshold. What has changed of them is written back."""
        limits = self.spark.createDataFrame([(r, self.config.large_file_size_for(r)) for r in self.config.roots], "root string, threshold long")
        found = materialize(tree.large_files(self.active_files(), limits).select("path"), "large")
        live = found.mapInPandas(_stats, "path string, size long, mtime double")
        old = self._read("files", FILES)
        self._write_back(snapshot.refresh(old.join(found, "path", "left_semi"), live), old)
        return tree.large_files(self.active_files().join(found, "path", "left_semi"), limits).orderBy(F.desc("size"), "path")

    def _write_back(self, refreshed: DataFrame, old: DataFrame) -> None:
        """The refreshed rows of files that differ from what is stored become a delta."""
        columns = [x.split()[0] for x in FILES.split(", ")]
        rows = materialize(snapshot.changed(refreshed.select(*columns), old.select(*columns), "path"), "refreshed")
        if not rows.isEmpty():
            self.stores["files"].upsert(rows)

    def report(self) -> Path:
        """The workbook: summary, duplicates, similarity, plans, execution."""
        state, groups, pairs = self._state(), self._read("groups", GROUPS), self._read("candidates", CANDIDATES)
        sheet = lambda df: chain([df.columns], map(tuple, df.toLocalIterator()))
        plan = artifacts.latest(self.config.home, "plan")
        done = artifacts.latest(self.config.home, "execution")
        plans = [("proposal_id", "action", "sources", "target", "state", "reason")]
        if plan:
            rows = artifacts.Plan.of(self.spark, plan).read("proposals").orderBy("proposal_id")
            plans = chain(plans, map(tuple, rows.select("proposal_id", "action", F.array_join("source_paths", "; "), "target_path", "approval_state", "reason").toLocalIterator()))
        runs = [("proposal_id", "status", "files", "bytes", "verified", "errors")] + [
            (r["proposal_id"], r["status"], r["files_copied"], r["bytes_copied"], r["verification_passed"], "; ".join(r["errors"])) for r in (artifacts.load(done)["proposal_results"] if done else [])
        ]
        summary = [("figure", "value"), ("scan run", state.get("scan", 0)), ("folders", self.active_folders().count()), ("files", self.active_files().count()), ("duplicate groups", groups.count()), ("similar pairs", pairs.count())]
        return xlsx.write(self.config.report, {"Summary": summary, "Duplicates": sheet(groups.orderBy(F.desc("total_bytes"))), "Similarity": sheet(pairs.orderBy(F.desc("score"), "folder_a", "folder_b")), "Plans": plans, "Execution": runs})

    def older(self, path: str | None = None) -> Path:
        """The older analysis: similar folders of which one was scanned since it was last analysed, the files they share by name and size confirmed by hashes, and its workbook."""
        folders, files = self.active_folders(), self.active_files().withColumn("h", F.lit(None).cast("string"))
        analysed = folders.join(self._read("older_analysed", ANALYSED), "path", "left")
        dirty = materialize(legacy.dirty(analysed).select("path"), "dirty")
        keys = legacy.signatures(files).join(folders.select(F.col("path").alias("folder")), "folder", "left_semi")
        new = legacy.similar(materialize(keys, "keys"), dirty, self.config.similarity_threshold)
        self.stores["older_results"].write(legacy.replace_results(self._read("older_results", RESULTS), new, dirty))
        results = self._read("older_results", RESULTS)
        # Pairs of files are confirmed once, until one of their folders is scanned again.
        old = self._read("older_matches", MATCHES).join(results.select("folder_a", "folder_b"), ["folder_a", "folder_b"], "left_semi")
        for side in ("folder_a", "folder_b"):
            old = old.join(dirty.withColumnRenamed("path", side), side, "left_anti")
        pairs = materialize(legacy.file_pairs(results, files, old).drop("h_a", "h_b"), "pairs")
        pairs = self._alike(self._alike(pairs, files, "quick", "quick_match", F.lit(True)), files, "full", "full_match", F.col("quick_match"))
        columns = [x.split()[0] for x in MATCHES.split(", ")]
        self.stores["older_matches"].write(materialize(old.select(*columns).unionByName(pairs.select(*columns)), "matches"))
        matches = self._read("older_matches", MATCHES)
        self.stores["older_analysed"].upsert(materialize(legacy.mark_analysed(analysed.join(dirty, "path", "left_semi"), F.unix_micros(F.current_timestamp()) / 1e6).select("path", "analysed_at"), "analysed"))
        stats = self._read("roots", ROOTS).select(
            "root", F.col("total_folders").alias("folders"), F.col("total_files").alias("files"), F.col("indexed_folders").alias("scanned_folders"), F.col("indexed_files").alias("scanned_files")
        )
        found = matches.filter("full_match").select("path_a", "path_b", "filename", "size", "folder_a", "folder_b", "jaccard")
        return legacy.workbook(path or f"{self.config.home}/older.xlsx", legacy.summary(stats, results, matches), found, legacy.similar_folders(results, folders, matches))

    def _alike(self, pairs: DataFrame, files: DataFrame, kind: str, name: str, asked: Column) -> DataFrame:
        """The pairs (path_a, path_b) with the column ``name``: whether the hashes of a kind agree, null where it was not asked."""
        paths_of = pairs.filter(asked).select(F.explode(F.array("path_a", "path_b")).alias("path")).distinct()
        hashed = materialize(hash_files(paths_of.join(files.select("path", "size"), "path"), kind).select("path", "digest"), "hashes")
        side = lambda s: hashed.select(F.col("path").alias(f"path_{s}"), F.col("digest").alias(f"__{s}"))
        rows = pairs.join(side("a"), "path_a", "left").join(side("b"), "path_b", "left")
        return materialize(rows.withColumn(name, F.when(asked, F.coalesce(F.col("__a") == F.col("__b"), F.lit(False)))).drop("__a", "__b"), "alike")

    def run(self, rescan: bool = False, delta: bool = False, replan: bool = False) -> dict:
        """All stages in order; nothing is executed."""
        self.preflight()
        out = {"scan_run": self.scan(rescan, delta), "duplicate_groups": self.duplicates(rescan).count(), "similar_pairs": self.similarity(rescan).count()}
        out |= {"plan": str(self.plan(replan)), "report": str(self.report())}
        found = [r.asDict() for r in materialize(self.waste(), "waste").collect()]
        out["waste_folders"] = artifacts.write_shortcuts(found, f"{self.config.home}/waste")
        return out | {"large_files": self.largest().count()}


def _there(batches):
    """root, exists of every path: whether it is still a folder."""
    for pdf in batches:
        yield pd.DataFrame({"root": pdf["path"], "exists": [os.path.isdir(p) for p in pdf["path"]]})


def _stats(batches):
    """path, size, mtime of the files that still exist."""
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                s = os.stat(path)
                rows.append((path, s.st_size, s.st_mtime))
            except OSError:
                continue
        yield pd.DataFrame(rows, columns=["path", "size", "mtime"])
