"""Folder trees on storage that every executor mounts, listed level by level.

Each level's folders are listed in parallel; a level is written before the next is listed,
so a lost executor costs part of one level. Excluded folders are not entered. In a delta
scan a folder that has not changed since it was last read is only looked through for
folders below it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators import snapshot
from stratafold.scratch import materialize

#: kind is folder, read or unchanged (a listed folder), file, or error with what could not be read and its code.
LISTING = (
    "kind string, path string, folder string, filename string, size long, mtime double, ctime double, depth int, "
    "what string, code long, message string, root string"
)


FOLDERS_A_TASK = 100
#: Entries that a task holds before it passes them on.
ROWS_A_BATCH = 10_000


def _error(e: OSError, what: str, path: str, folder: str, depth: int, root: str) -> tuple:
    return ("error", path, folder, None, None, None, None, depth, what, getattr(e, "winerror", None), e.strerror or str(e), root)


def _list(batches: Iterator[pd.DataFrame], excluded: frozenset[str], links: bool = False) -> Iterator[pd.DataFrame]:
    """Rows of LISTING for every folder (path, depth, root, changed) and what lies in it; ``links`` to files count as files."""
    for pdf in batches:
        rows: list[tuple] = []
        for folder, depth, root, changed in zip(pdf["path"], pdf["depth"], pdf["root"], pdf["changed"]):
            try:
                with os.scandir(folder) as entries:
                    rows.append(("read" if changed else "unchanged", folder, folder, None, None, None, None, depth, None, None, None, root))
                    for e in entries:
                        rows += _entry(e, folder, depth, root, changed, excluded, links)
                        if len(rows) >= ROWS_A_BATCH:  # a folder of any size is passed on piece by piece
                            yield _frame(rows)
                            rows = []
            except OSError as e:
                rows.append(_error(e, "folder", folder, folder, depth, root))
            if len(rows) >= ROWS_A_BATCH:
                yield _frame(rows)
                rows = []
        yield _frame(rows)


def _entry(e: os.DirEntry, folder: str, depth: int, root: str, changed: bool, excluded: frozenset[str], links: bool) -> list[tuple]:
    """The row of one entry of a folder, or none."""
    what = "entry"
    try:
        if e.is_dir(follow_symlinks=False):
            return [] if e.name in excluded else [("folder", e.path, folder, e.name, None, e.stat().st_mtime, None, depth + 1, None, None, None, root)]
        if changed and e.is_file(follow_symlinks=links):
            what = "file"
            s = e.stat()
            return [("file", e.path, folder, e.name, s.st_size, s.st_mtime, s.st_ctime, depth, None, None, None, root)]
    except OSError as x:
        return [_error(x, what, e.path, folder, depth, root)]
    return []


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in LISTING.split(", ")])


class Stopped(RuntimeError):
    """The walk was ended early; ``listing`` holds what was listed until then."""

    def __init__(self, reason: str, listing: DataFrame):
        super().__init__(reason)
        self.listing = listing


def walk(
    spark: SparkSession, roots: list[str], excluded=frozenset(), tasks: int = 4096, read_at: DataFrame | None = None,
    before_batch: Callable[[int, int, int], str | None] = lambda level, done, folders: None,
) -> DataFrame:
    """The listing of all roots; a root below another is listed once, one that is no folder not at all.

    ``read_at`` (path, last_scan as epoch seconds): folders not changed since then are not
    read again. A level is listed in batches of as many folders as ``tasks`` take;
    ``before_batch`` gets the level, how many of its folders are done and how many it has,
    and ends the walk by returning a reason. What was listed by then is kept.
    """
    there = [(r, os.stat(r).st_mtime) for r in dict.fromkeys(roots) if os.path.isdir(r)]
    start = [("folder", r, None, os.path.basename(r), None, m, None, 0, None, None, None, r) for r, m in there if not any(r.startswith(o + "/") for o, _ in there)]
    level, number = spark.createDataFrame(start, LISTING), 0
    found, names = level, frozenset(excluded)
    while count := level.count():
        listed = level.select("path", "depth", "root", "mtime")
        if read_at is None:
            listed = listed.withColumn("changed", F.lit(True))
        else:
            changed = snapshot.to_scan(listed, read_at).select("path", F.lit(True).alias("changed"))
            listed = listed.join(changed, "path", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
        batches, done, below = -(-count // (tasks * FOLDERS_A_TASK)), 0, None
        if batches > 1:
            listed = materialize(listed.withColumn("batch", F.pmod(F.xxhash64("path"), F.lit(batches))), "level")
        for batch in range(batches):
            if reason := before_batch(number, done, count):
                raise Stopped(reason, found)
            rows = listed.filter(F.col("batch") == batch).drop("batch") if batches > 1 else listed
            rows = rows.repartition(min(tasks, -(-count // (batches * FOLDERS_A_TASK))))
            piece = materialize(rows.mapInPandas(lambda it: _list(it, names), LISTING), "listing")
            found = found.unionByName(piece)
            below = piece if below is None else below.unionByName(piece)
            done += count if batches == 1 else rows.count()
        level, number = below.filter("kind = 'folder'"), number + 1
    return found


def below(roots: DataFrame, tasks: int = 4096) -> DataFrame:
    """The listing of every folder named in ``roots`` (column path), each by itself even where one lies below another; links to files are listed."""
    empty = {n: F.lit(None).cast(t) for n, t in (c.split() for c in LISTING.split(", "))}
    start = roots.select(F.col("path")).distinct().withColumns({**{n: c for n, c in empty.items() if n != "path"}, "kind": F.lit("folder"), "depth": F.lit(0), "root": F.col("path")})
    level = materialize(start.select(*empty), "listing")
    found = level
    while count := level.count():
        listed = level.select("path", "depth", "root", F.lit(True).alias("changed")).repartition(min(tasks, -(-count // FOLDERS_A_TASK)))
        step = materialize(listed.mapInPandas(lambda it: _list(it, frozenset(), True), LISTING), "listing")
        found, level = found.unionByName(step), step.filter("kind = 'folder'")
    return found


def count_folders(spark: SparkSession, roots: list[str], excluded=frozenset()) -> int:
    """How many folders a scan will enter, the roots included."""
    return walk(spark, roots, excluded).filter("kind = 'folder'").count()


def inventory(listing: DataFrame, suffixes_out=(), least: int = 0, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(folders, files) of a listing, with direct totals over the files that pass the filters."""
    from stratafold.operators import tree

    files = listing.filter("kind = 'file'").select("folder", "filename", "path", "size", "mtime", "ctime")
    files = tree.allowed(files, (), tuple(suffixes_out), least, most)
    direct = files.groupBy("folder").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))
    # A folder that could not be read, or need not be, keeps the row it has.
    read = listing.filter("kind = 'read'").select("path")
    folders = listing.filter("kind = 'folder'").select("path", F.col("folder").alias("parent"), "depth", "mtime").join(read, "path")
    folders = folders.join(direct.withColumnRenamed("folder", "path"), "path", "left").na.fill(0, ["file_count", "total_bytes"])
    return folders, files
