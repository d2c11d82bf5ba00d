"""Carrying out approved entries on the executors: copies and checks, never deletes.

The approved entries of a plan become one row per file to copy. Each is looked at once
(``inspected``), which fixes what is to happen before anything is written: ``copy`` where
the target has nothing, else a comparison. Files are cut into parts of PART_BYTES, parts
are dealt to tasks by their bytes, so neither a large file nor a folder of many small ones
is one task. A part is written at its place in a hidden file beside the target and read
back; once all parts of a file are there it gets its name (``_commit``). All of it may be
repeated: a part writes the same bytes at the same place, and a target that an earlier
attempt named counts as copied if it holds the source's content. Results are rows, written
to a table; the driver sees one row per entry.

Sources and targets lie on storage that every executor mounts.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions import paths
from stratafold.functions.hashing import CHUNK, full_hash
from stratafold.operators.ordering import by_weight, with_running
from stratafold.plans import artifacts
from stratafold.scratch import materialize
from stratafold.sources import walk

MARKER = ".stratafold-merged"
#: Bytes of a part, of the parts of one task, and what opening a file counts for.
PART_BYTES, TASK_BYTES, FILE_COST = 256 << 20, 1 << 30, 64 << 10
#: Errors that the artifact lists for an entry; the table of results has all.
ERRORS_LISTED = 1000

TASKS = "entry string, rank long, unit string, source string, target string, error string"
RESULTS = "entry string, unit string, source string, target string, size long, status string, error string"


def files_match(a: str | Path, b: str | Path) -> bool:
    """Both exist with equal size and content; what cannot be read does not match."""
    try:
        return os.stat(a).st_size == os.stat(b).st_size and full_hash(str(a)) == full_hash(str(b))
    except OSError:
        return False


# ---------------------------------------------------------------- what one executor does


def _rows(names: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")])


def _blocks(f, lo: int, hi: int) -> Iterator[bytes]:
    f.seek(lo)
    while lo < hi and (block := f.read(min(CHUNK, hi - lo))):
        lo += len(block)
        yield block


def _digest(f, lo: int, hi: int) -> tuple[int, str]:
    state, n = xxhash.xxh3_128(), 0
    for block in _blocks(f, lo, hi):
        state.update(block)
        n += len(block)
    return n, state.hexdigest()


def _copy_part(source: str, hidden: str, lo: int, hi: int) -> str | None:
    """Writes a part at its place and reads it back; gives what went wrong."""
    try:
        os.makedirs(os.path.dirname(hidden), exist_ok=True)
        with open(source, "rb") as f, open(os.open(hidden, os.O_RDWR | os.O_CREAT, 0o600), "r+b") as out:
            out.seek(lo)
            state, n = xxhash.xxh3_128(), 0
            for block in _blocks(f, lo, hi):
                out.write(block)
                state.update(block)
                n += len(block)
            out.flush()
            os.fsync(out.fileno())
            if n != hi - lo:
                return f"{source} changed while it was copied"
            return None if _digest(out, lo, hi) == (n, state.hexdigest()) else f"{hidden} differs from {source} after copying"
    except OSError as e:
        return f"{source} was not copied: {e}"


def _same_part(source: str, target: str, lo: int, hi: int) -> str | None:
    try:
        with open(source, "rb") as f, open(target, "rb") as g:
            alike = os.fstat(f.fileno()).st_size == os.fstat(g.fileno()).st_size and _digest(f, lo, hi) == _digest(g, lo, hi)
        return None if alike else "conflict"
    except OSError as e:
        return f"{target} was not compared with {source}: {e}"


def _drop(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass


def _commit(source: str, hidden: str, target: str, size: int) -> tuple[str, str | None]:
    """Gives the whole hidden file its name, unless another file has it by now: status and error."""
    conflict = "conflict", f"{target} already exists with different content"
    try:
        if not os.path.exists(hidden):  # an earlier attempt was here
            return ("copied", None) if files_match(source, target) else ("failed", f"{target} was not made")
        if os.path.getsize(hidden) != size:
            _drop(hidden)
            return "failed", f"{source} changed while it was copied"
        shutil.copystat(source, hidden)
        try:
            os.link(hidden, target)  # never replaces a file
        except FileExistsError:
            same = files_match(hidden, target)
            _drop(hidden)
            return ("copied", None) if same else conflict
        except OSError:  # storage without links
            if os.path.exists(target):
                return conflict
            os.rename(hidden, target)
        _drop(hidden)
        return "copied", None
    except OSError as e:
        return "failed", f"{source} was not copied to {target}: {e}"


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for source, target in zip(pdf["source"], pdf["target"]):
            size = there = error = None
            try:
                size = os.stat(source).st_size
                there = os.stat(target).st_size if os.path.lexists(target) else None
            except OSError as e:
                error = f"{source} was not copied to {target}: {e}"
            out.append((size, there, error))
        yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(out, columns=["size", "there", "fault"], dtype=object)], axis=1)


# ---------------------------------------------------------------- the jobs


def _hidden(target: Column) -> Column:
    """The name of the file in which a target grows: the same in every attempt."""
    return F.concat(paths.parent(target), F.lit("/.stratafold-"), F.hex(F.xxhash64(target)), F.lit(".part"))


def _by_parts(rows: DataFrame, other: str, work: Callable[[str, str, int, int], str | None]) -> DataFrame:
    """source, target, error of every pair once ``work`` has done all its parts; error is that of the first part that has one."""
    n = F.greatest(F.ceil(F.col("size") / F.lit(PART_BYTES)), F.lit(1)).cast("long")
    parts = rows.select("source", "target", other, "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("part"))
    parts = parts.withColumn("lo", F.col("part") * PART_BYTES).withColumn("hi", F.least(F.col("lo") + PART_BYTES, F.col("size")))
    parts = by_weight(parts.withColumn("cost", F.col("hi") - F.col("lo") + FILE_COST), ["target", "source", "part"], "cost", TASK_BYTES)

    def run(batches):
        for pdf in batches:
            done = [(s, t, p, work(s, x, lo, hi)) for s, t, p, x, lo, hi in zip(pdf["source"], pdf["target"], pdf["part"], pdf[other], pdf["lo"], pdf["hi"])]
            yield _rows("source, target, part, error", done)

    done = parts.select(*dict.fromkeys(["source", "target", "part", other, "lo", "hi"])).mapInPandas(run, "source string, target string, part long, error string")
    return materialize(done.groupBy("source", "target").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("part"))).alias("error")), "parts")


def carried_out(tasks: DataFrame, copy_part: Callable[[str, str, int, int], str | None] = _copy_part) -> DataFrame:
    """Copies what the rows of TASKS ask for; gives RESULTS with status copied, same, conflict or failed.

    Of several files for one target the first by rank, unit and source is copied, the others
    are compared with it. Only ``conflict`` and ``failed`` have an error.
    """
    looked = tasks.filter("error is null").repartition("target")
    looked = materialize(looked.mapInPandas(_inspect, f"{TASKS}, size long, there long, fault string"), "inspected")
    good = looked.filter("fault is null")
    turn = F.row_number().over(W.partitionBy("target").orderBy("rank", "unit", "source"))
    good = materialize(good.withColumn("copies", (turn == 1) & F.col("there").isNull()), "claims")

    copies = good.filter("copies").withColumn("hidden", _hidden(F.col("target")))
    written = _by_parts(copies, "hidden", copy_part)

    def commit(batches):
        for pdf in batches:
            out = []
            for source, hidden, target, size, error in zip(pdf["source"], pdf["hidden"], pdf["target"], pdf["size"], pdf["error"]):
                if error:
                    _drop(hidden)
                out.append((source, target, *(("failed", error) if error else _commit(source, hidden, target, int(size)))))
            yield _rows("source, target, status, error", out)

    ready = copies.select("source", "target", "hidden", "size").join(written, ["source", "target"])
    copied = materialize(ready.mapInPandas(commit, "source string, target string, status string, error string"), "copied")

    # Compared once the copies are there: what had a target, and what came second to one.
    pairs = good.filter("not copies")
    alike = pairs.filter("there is null or there = size").select("source", "target", "size").distinct().withColumn("beside", F.col("target"))
    compared = _by_parts(alike, "beside", _same_part).withColumnRenamed("error", "found")
    conflict = F.concat("target", F.lit(" already exists with different content"))
    verdict = pairs.join(compared, ["source", "target"], "left")
    differs = (F.col("found") == "conflict") | (F.col("there") != F.col("size"))
    verdict = verdict.withColumn("status", F.when(differs, "conflict").when(F.col("found").isNotNull(), "failed").otherwise("same"))
    verdict = verdict.withColumn("error", F.when(differs, conflict).otherwise(F.col("found")))
    columns = [c.split()[0] for c in RESULTS.split(", ")]
    done = good.filter("copies").drop("error").join(copied, ["source", "target"]).select(*columns).unionByName(verdict.select(*columns))
    unread = looked.filter("fault is not null").withColumn("error", F.col("fault")).unionByName(tasks.filter("error is not null"), allowMissingColumns=True)
    return materialize(done.unionByName(unread.withColumn("status", F.lit("failed")).select(*columns)), "results")


def tree_tasks(roots: DataFrame) -> DataFrame:
    """TASKS for whole trees; ``roots``: entry, rank, unit (the source folder), to (the target folder). What cannot be listed is a row with an error."""
    listing = walk.below(roots.select(F.col("unit").alias("path")))
    rows = roots.join(listing.filter("kind in ('file', 'error')").withColumnRenamed("root", "unit"), "unit")
    to = F.concat("to", F.lit("/"), paths.relative(F.col("path"), F.col("unit")))
    error = F.when(F.col("kind") == "error", F.concat(F.lit("cannot read "), "path", F.lit(": "), "message"))
    return rows.select("entry", F.col("rank").cast("long").alias("rank"), "unit", F.col("path").alias("source"), to.alias("target"), error.alias("error"))


def cluster_tasks(masters: DataFrame, unique: DataFrame) -> DataFrame:
    """TASKS that bring the unique files (cluster_id, copy, path) to the masters (cluster_id, rank, master)."""
    rows = unique.join(masters, "cluster_id")
    to = F.concat("master", F.lit("/"), paths.relative(F.col("path"), F.col("copy")))
    return rows.select(F.col("cluster_id").alias("entry"), "rank", F.col("copy").alias("unit"), F.col("path").alias("source"), to.alias("target"), F.lit(None).cast("string").alias("error"))


def copy_tree(spark: SparkSession, source: str, target: str) -> DataFrame:
    """RESULTS of copying one folder tree into another."""
    return carried_out(tree_tasks(spark.createDataFrame([("tree", 0, source, target)], "entry string, rank long, unit string, to string")))


def verify_tree(spark: SparkSession, source: str, target: str) -> bool:
    """Whether every file below the source stands below the target with the same content."""
    tasks = tree_tasks(spark.createDataFrame([("tree", 0, source, target)], "entry string, rank long, unit string, to string")).filter("error is null")
    looked = materialize(tasks.mapInPandas(_inspect, f"{TASKS}, size long, there long, fault string"), "inspected")
    if not looked.filter("fault is not null or there is null or there <> size").isEmpty():
        return False
    pairs = looked.select("source", "target", "size").withColumn("beside", F.col("target"))
    return _by_parts(pairs, "beside", _same_part).filter("error is not null").isEmpty()


def _mark(copies: DataFrame) -> DataFrame:
    """Marks copies (copy, master) that are fully held by their master; gives copy and error of those that could not be marked."""

    def run(batches):
        for pdf in batches:
            out = []
            for copy, master in zip(pdf["copy"], pdf["master"]):
                try:
                    (Path(copy) / MARKER).write_text(f"Merged into: {master}\n")
                except OSError as e:
                    out.append((copy, str(e)))
            yield _rows("copy, error", out)

    return materialize(copies.select("copy", "master").distinct().mapInPandas(run, "copy string, error string"), "marked")


def _entries(plan: artifacts.Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approved proposals (rank, entry, action, source_paths, target_path), approved clusters (rank, entry, master), and the clusters' copies (entry, copy)."""
    proposals = plan.read("proposals").filter("approval_state = 'approved'").select(F.col("proposal_id").alias("entry"), "action", "source_paths", "target_path")
    clusters = plan.read("clusters").filter("status = 'approved'").select(F.col("cluster_id").alias("entry"), "top")
    members = plan.read("members").select(F.col("cluster_id").alias("entry"), "path", "is_master").join(clusters.select("entry"), "entry")
    masters = members.filter("is_master").groupBy("entry").agg(F.min("path").alias("master"))
    # Entries run as if in their order: proposals by id, then clusters, the shallowest first.
    rank = lambda first, *order: F.struct(F.lit(first).alias("kind"), *order)
    both = proposals.select("entry", rank(0, F.lit(0).alias("top"), "entry").alias("o")).unionByName(clusters.select("entry", rank(1, "top", "entry").alias("o")))
    ranks = materialize(with_running(both.select("entry", F.col("o.kind").alias("kind"), F.col("o.top").alias("top")), ["kind", "top", "entry"]), "ranks")
    ranks = ranks.select("entry", "kind", F.col("place").alias("rank"))
    first = ranks.filter("kind = 0").drop("kind").join(proposals, "entry")
    second = ranks.filter("kind = 1").drop("kind").join(masters, "entry", "left")
    return materialize(first, "proposals"), materialize(second, "clusters"), members.filter("not is_master").select("entry", F.col("path").alias("copy"))


def run_plan(spark: SparkSession, plan_path: str | Path, folder: str | Path) -> Path:
    """Runs what is approved in a plan, its JSON or its folder of tables; writes execution-<id>.json and, beside it, the table of all results."""
    plan = artifacts.Plan.of(spark, plan_path)
    proposals, clusters, copies = _entries(plan)
    acts = F.col("action").isin("merge_folder", "move_folder") & (F.coalesce("target_path", F.lit("")) != "")
    roots = proposals.filter(acts).select("entry", "rank", F.explode("source_paths").alias("unit"), F.col("target_path").alias("to"))
    mastered = clusters.filter("master is not null")
    unique = plan.read("unique_files").select("cluster_id", "copy", "path")
    wanted = tree_tasks(roots).unionByName(cluster_tasks(mastered.withColumnRenamed("entry", "cluster_id"), unique))
    results = carried_out(materialize(wanted, "tasks"))

    faulty = results.filter("error is not null")
    done = copies.join(mastered, "entry").join(faulty.select("entry", F.col("unit").alias("copy")), ["entry", "copy"], "left_anti")
    for r in _mark(done).toLocalIterator():
        print(f"no marker in {r['copy']}: {r['error']}")

    made = uuid.uuid4().hex
    place = f"{folder}/results-{made}"
    results.write.parquet(place)
    listed = faulty.withColumn("n", F.row_number().over(W.partitionBy("entry").orderBy("target", "source"))).filter(F.col("n") <= ERRORS_LISTED)
    errors = listed.groupBy("entry").agg(F.array_sort(F.collect_list("error")).alias("errors"))
    copied = F.col("status") == "copied"
    totals = results.groupBy("entry").agg(
        F.sum(copied.cast("long")).alias("files_copied"), F.sum(F.when(copied, F.col("size")).otherwise(0)).alias("bytes_copied"), F.sum(F.col("error").isNotNull().cast("long")).alias("n_errors")
    )
    rows = proposals.select("entry", "rank", F.when(acts, "run").when(F.col("action") == "mark_backup", "backup").otherwise("none").alias("kind"))
    rows = rows.unionByName(clusters.select("entry", "rank", F.when(F.col("master").isNull(), "headless").otherwise("run").alias("kind")))
    rows = rows.join(totals, "entry", "left").join(errors, "entry", "left").orderBy("rank")
    return artifacts.write_execution(folder, artifacts.header(plan_path)["plan_id"] if Path(plan_path).is_file() else Path(plan_path).name.removeprefix("plan-"), map(_summary, rows.toLocalIterator()), place)


def _summary(row) -> dict:
    """An entry of the execution artifact."""
    errors, whole = row["errors"] or [], row["kind"] == "run" and not row["n_errors"]
    if row["kind"] == "headless":
        errors = ["the cluster has no master"]
    return {
        "proposal_id": row["entry"], "status": "skipped" if row["kind"] in ("none", "backup") else "completed" if whole else "failed",
        "files_copied": row["files_copied"] or 0, "bytes_copied": row["bytes_copied"] or 0, "verification_passed": whole or row["kind"] == "backup",
        "source_cleanup_allowed": whole, "errors": errors, "n_errors": row["n_errors"] or len(errors),
    }
