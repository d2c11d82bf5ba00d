"""Versioned inventory tables without an in-place MERGE: each change gives a new version."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions import paths
from stratafold.scratch import delete, size_of


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old rows, replaced by or extended with the new ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def upsert_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, quick_hash, full_hash: a null in the new row keeps the old hash."""
    fresh = new.select("path", F.col("quick_hash").alias("q"), F.col("full_hash").alias("f"))
    return old.join(fresh, "path", "full_outer").select(
        "path", F.coalesce("q", "quick_hash").alias("quick_hash"), F.coalesce("f", "full_hash").alias("full_hash")
    )


def reject_unknown(files: DataFrame, folder_rows: DataFrame) -> DataFrame:
    """The files whose folder is not in the snapshot."""
    return files.join(folder_rows.select(F.col("path").alias("folder")), "folder", "left_anti")


def tombstone(rows: DataFrame, root: str, run_id: int) -> DataFrame:
    """Rows under the root that an older run saw last become missing."""
    gone = paths.under(F.col("path"), F.lit(root)) & (F.col("run_id") < run_id)
    return rows.withColumn("is_missing", F.when(gone, True).otherwise(F.col("is_missing")))


def promote(rows: DataFrame, unchanged: DataFrame, run_id: int, folder: str = "folder") -> DataFrame:
    """Rows of unchanged folders (column ``folder``) move to the run; nothing else changes."""
    kept = unchanged.select(F.col("folder").alias(folder), F.lit(True).alias("__kept")).distinct()
    return rows.join(kept, folder, "left").withColumn("run_id", F.when(F.col("__kept"), run_id).otherwise(F.col("run_id"))).drop("__kept")


def refresh(rows: DataFrame, live: DataFrame) -> DataFrame:
    """path, size, mtime, is_missing against a live listing (path, size, mtime)."""
    seen = live.select("path", F.col("size").alias("s"), F.col("mtime").alias("t"), F.lit(True).alias("there"))
    return rows.join(seen, "path", "left").withColumns(
        {"size": F.coalesce("s", "size"), "mtime": F.coalesce("t", "mtime"), "is_missing": F.col("there").isNull()}
    ).drop("s", "t", "there")


def refresh_subtrees(rows: DataFrame, roots: DataFrame, live: DataFrame) -> DataFrame:
    """Rows under each root (root, exists): all missing where the root is gone, else refreshed."""
    below = rows.withColumn("root", F.explode(paths.ancestors(F.col("path"), 1))).join(roots, "root")
    state = below.groupBy("path").agg(F.bool_and("exists").alias("exists"))
    fresh = refresh(rows.join(state.filter("exists").select("path"), "path", "left_semi"), live)
    gone = rows.join(state.filter("not exists").select("path"), "path", "left_semi").withColumn("is_missing", F.lit(True))
    return rows.join(state.select("path"), "path", "left_anti").unionByName(fresh).unionByName(gone)


def to_scan(listing: DataFrame, state: DataFrame, rescan: bool = False) -> DataFrame:
    """Folders of a delta scan to read: changed after their last scan, or never scanned."""
    rows = listing.join(state.select("path", "last_scan"), "path", "left")
    return rows if rescan else rows.filter("last_scan is null or mtime > last_scan")


def next_run(runs: DataFrame) -> int:
    return (runs.agg(F.max("run_id")).first()[0] or 0) + 1


def scan_stats(files: DataFrame, folder_rows: DataFrame, depth: int = 2) -> DataFrame:
    """root, folders, files, bytes: totals of each tree."""
    root = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, depth), "/")
    f = files.groupBy(root("folder").alias("root")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    d = folder_rows.groupBy(root("path").alias("root")).agg(F.count("*").alias("folders"))
    return d.join(f, "root", "left").na.fill(0, ["files", "bytes"])


def root_stats(listing: DataFrame, files: DataFrame, run_id: int) -> DataFrame:
    """Per root of a listing: folders and files met, and of these those that are indexed (folders read, files that pass the filters)."""
    met = listing.groupBy("root").agg(
        *[F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(name) for kind, name in (("folder", "total_folders"), ("file", "total_files"), ("read", "indexed_folders"))]
    )
    kept = listing.filter("kind = 'file'").join(files.select("path"), "path").groupBy("root").agg(F.count("*").alias("indexed_files"))
    return met.join(kept, "root", "left").na.fill(0, ["indexed_files"]).select(
        "root", F.lit(run_id).cast("long").alias("run_id"), "total_folders", "total_files", "indexed_folders", "indexed_files"
    )


def stale_roots(roots: DataFrame, stats: DataFrame, now: Column, max_age_days: int) -> DataFrame:
    """root, age_days of roots never scanned (null) or last scanned before now - max_age."""
    rows = roots.join(stats.select("root", "last_scanned_at"), "root", "left")
    old = F.col("last_scanned_at") < now - F.expr(f"interval {max_age_days} days")
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_scanned_at")) / 86400).cast("long")
    return rows.filter(F.col("last_scanned_at").isNull() | old).select("root", age.alias("age_days"))


def stage_is_current(state: DataFrame, stage: str, needs: tuple[str, ...], run_id: int) -> bool:
    """Whether the stage and those it needs have seen the run."""
    seen = {r["stage"]: r["run_id"] for r in state.filter(F.col("stage").isin(stage, *needs)).collect()}
    return all(seen.get(s, 0) >= run_id for s in (stage, *needs))


def set_stage(state: DataFrame, stage: str, run_id: int) -> DataFrame:
    return state.filter(F.col("stage") != stage).union(state.sparkSession.createDataFrame([(stage, run_id)], state.schema))


def with_columns(rows: DataFrame, wanted: dict[str, tuple[str, str | None]], renamed: dict[str, str] | None = None) -> DataFrame:
    """Additive migration: renames old columns, adds missing ones (type, default as SQL) and keeps the rest."""
    for old, new in (renamed or {}).items():
        rows = rows.withColumnRenamed(old, new) if old in rows.columns and new not in rows.columns else rows
    for name, (kind, default) in wanted.items():
        rows = rows if name in rows.columns else rows.withColumn(name, F.expr(default or "null").cast(kind))
    return rows


def latest_rows(versions: DataFrame, key: str, run: str = "run_id") -> DataFrame:
    """The newest version of every key."""
    return versions.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(run)))).filter("__n = 1").drop("__n")


def merged(base: DataFrame, deltas: list[DataFrame], key: str) -> DataFrame:
    """The base with its deltas laid over it, the oldest first: the newest row of every key."""
    if not deltas:
        return base
    versions = [d.withColumn("__version", F.lit(i)) for i, d in enumerate(deltas)]
    newest = versions[0]
    for v in versions[1:]:
        newest = newest.unionByName(v, allowMissingColumns=True)
    newest = latest_rows(newest, key, "__version").drop("__version")
    return base.join(newest.select(key), key, "left_anti").unionByName(newest, allowMissingColumns=True)


def seen_since(rows: DataFrame, seen: dict[str, int]) -> DataFrame:
    """Rows that are not missing belong to the newest run that saw the whole tree (root to run) they lie in."""
    run = F.col("run_id")
    for root, number in sorted(seen.items()):
        run = F.when(paths.under(F.col("path"), F.lit(root)) & ~F.col("is_missing"), F.greatest(run, F.lit(number))).otherwise(run)
    return rows.withColumn("run_id", run)


def changed(rows: DataFrame, old: DataFrame, key: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """The rows that differ from the old row of their key in any column but the ignored ones, or have none."""
    columns = [c for c in rows.columns if c not in ignore]
    was = old.select(F.col(key).alias("__key"), F.struct(*columns).alias("__was"))
    return rows.join(was, rows[key] == was["__key"], "left").filter(~F.struct(*columns).eqNullSafe(F.col("__was"))).drop("__key", "__was")


#: One row per version: whether it is a base (then base = run), its buckets, and the trees that a run saw whole.
POINTER = "run long, base long, buckets int, seen map<string, long>"


class SnapshotStore:
    """A table in versions, merge-on-read: bases hold all rows, deltas only the rows that changed since.

    Versions are ``run=N`` folders under a path; a pointer row makes one visible once it is
    complete. ``read`` lays the deltas of the newest base over it. A delta that would make
    them more than MOST_DELTAS, or larger than COMPACT times the base (and LEAST bytes), is written as a new
    base instead, so what is written grows with the change and what is read stays near the
    table. With ``buckets`` the bases are bucketed and sorted by the key: tables bucketed
    alike join on it without a shuffle.
    """

    MOST_DELTAS, COMPACT, LEAST = 8, 0.5, 1 << 20

    def __init__(self, spark: SparkSession, path: str, key: str = "path", buckets: int = 0):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _versions(self) -> list:
        """The pointer's rows by run: as many as there were versions, whatever the table holds."""
        try:
            rows = self.spark.read.schema(POINTER).parquet(f"{self.path}/pointer").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted({r["run"]: r for r in rows}.values(), key=lambda r: r["run"])

    def current(self) -> int:
        return max((r["run"] for r in self._versions()), default=0)

    def _point(self, run: int, base: int, seen: dict[str, int]) -> None:
        self.spark.createDataFrame([(run, base, self.buckets, seen)], POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/pointer")

    def _table(self, run: int) -> str:
        """The name under which the session's catalog knows a bucketed base."""
        return f"stratafold_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{run}"

    def write(self, rows: DataFrame, keep: int = 3) -> int:
        """Writes all rows as the next version, a base; all but the newest ``keep`` bases, and deltas older than them, go."""
        versions = self._versions()
        run = max((r["run"] for r in versions), default=0) + 1
        place = f"{self.path}/run={run}"
        if self.buckets:
            self.spark.sql(f"drop table if exists {self._table(run)}")
            delete(self.spark, place)
            dealt = rows.repartition(self.buckets, self.key).write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
            dealt.option("path", place).saveAsTable(self._table(run))
        else:
            rows.write.mode("overwrite").parquet(place)
        self._point(run, run, {})
        bases = [r["run"] for r in versions if r["base"] in (None, r["run"])] + [run]
        if len(bases) > keep:
            for r in versions:
                if bases[-keep - 1] <= r["run"] < bases[-keep]:
                    delete(self.spark, f"{self.path}/run={r['run']}")
        return run

    def upsert(self, rows: DataFrame, seen: dict[str, int] | None = None) -> int:
        """The next version: ``rows`` (one per key) replace or extend the newest ones; ``seen`` names the trees a run saw whole."""
        versions = self._versions()
        if not versions:
            return self.write(rows)
        base = versions[-1]["base"] or versions[-1]["run"]
        run, deltas = versions[-1]["run"] + 1, [r["run"] for r in versions if r["base"] == base and r["run"] > base]
        place = f"{self.path}/run={run}"
        rows.write.mode("overwrite").parquet(place)
        size = sum(size_of(self.spark, f"{self.path}/run={r}") for r in [*deltas, run])
        self._point(run, base, seen or {})
        if len(deltas) < self.MOST_DELTAS and size <= max(self.LEAST, self.COMPACT * size_of(self.spark, f"{self.path}/run={base}")):
            return run
        return self.write(self.read(run))

    def _base(self, run: int, buckets: int) -> DataFrame:
        if not buckets:
            return self.spark.read.parquet(f"{self.path}/run={run}")
        if not self.spark.catalog.tableExists(self._table(run)):  # written by another session
            columns = self.spark.read.parquet(f"{self.path}/run={run}").schema
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
            self.spark.sql(
                f"create table {self._table(run)} ({ddl}) using parquet clustered by (`{self.key}`) sorted by (`{self.key}`) into {buckets} buckets location '{self.path}/run={run}'"
            )
        return self.spark.table(self._table(run))

    def read(self, run: int | None = None) -> DataFrame:
        """The rows of a version, the newest one unless named."""
        rows = self.get(run)
        if rows is None:
            raise ValueError(f"no version was written to {self.path}")
        return rows

    def get(self, run: int | None = None) -> DataFrame | None:
        """As ``read``; None where nothing was written yet."""
        versions = {r["run"]: r for r in self._versions()}
        if not versions:
            return None
        run = run or max(versions)
        base = versions[run]["base"] or run
        deltas = [r for n, r in sorted(versions.items()) if base < n <= run and r["base"] == base]
        rows = merged(self._base(base, versions[base]["buckets"] or 0), [self.spark.read.parquet(f"{self.path}/run={r['run']}") for r in deltas], self.key)
        seen: dict[str, int] = {}
        for r in deltas:
            for root, number in (r["seen"] or {}).items():
                seen[root] = max(number, seen.get(root, 0))
        return seen_since(rows, seen) if seen else rows
