"""Exact duplicates through a funnel: size, quick hash, full hash.

A hash exists only for files that the stage before left in doubt; all others keep null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.scratch import materialize


def crowded(files: DataFrame, keys: list[str]) -> DataFrame:
    """The files whose keys (none null) at least two files share."""
    many = files.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return files.join(many, keys, "left_semi")


def funnel(files: DataFrame, quick: Callable[[DataFrame], DataFrame], full: Callable[[DataFrame], DataFrame], least: int, known: DataFrame | None = None) -> DataFrame:
    """path, quick_hash, full_hash, settled in stages.

    ``quick`` and ``full`` give path, digest for the files they get; ``known`` (path,
    quick_hash, full_hash) spares files that are hashed already. Each stage is written
    before the next, so no file is read twice.
    """
    rows = files.select("path", "size")
    rows = rows.join(known.select("path", "quick_hash", "full_hash"), "path", "left") if known is not None else rows.withColumns(
        {"quick_hash": F.lit(None).cast("string"), "full_hash": F.lit(None).cast("string")}
    )
    stage = rows.filter(F.col("size") >= least)
    for keys, column, digest in ((["size"], "quick_hash", quick), (["size", "quick_hash"], "full_hash", full)):
        left = crowded(stage, keys)
        fresh = digest(left.filter(F.col(column).isNull())).select("path", F.col("digest").alias("__new"))
        stage = materialize(
            left.join(fresh, "path", "left").withColumn(column, F.coalesce(column, "__new")).drop("__new"), "hashes"
        )
        rows = rows.join(stage.select("path", F.col(column).alias("__new")), "path", "left").withColumn(
            column, F.coalesce("__new", column)
        ).drop("__new")
    return rows.select("path", "quick_hash", "full_hash")


def groups(files: DataFrame, least: int = 0, hash_column: str = "h") -> DataFrame:
    """full_hash, size_bytes, file_count, total_bytes of content that at least two files hold."""
    rows = files.filter((F.col("size") >= least) & F.col(hash_column).isNotNull())
    out = rows.groupBy(F.col(hash_column).alias("full_hash"), F.col("size").alias("size_bytes")).agg(F.count("*").alias("file_count"))
    return out.filter("file_count > 1").withColumn("total_bytes", F.col("file_count") * F.col("size_bytes"))


def members(files: DataFrame, grouped: DataFrame, hash_column: str = "h") -> DataFrame:
    """full_hash, size_bytes, path of every member."""
    rows = files.select(F.col(hash_column).alias("full_hash"), F.col("size").alias("size_bytes"), "folder", "path")
    return rows.join(grouped.select("full_hash", "size_bytes"), ["full_hash", "size_bytes"])


def funnel_counts(files: DataFrame, quick: str, full: str, least: int = 0) -> DataFrame:
    """How many files each stage leaves, and how many groups stand at the end."""
    eligible = files.filter(F.col("size") >= least)
    first = crowded(eligible, ["size"])
    second = crowded(first, ["size", quick])
    third = crowded(second, ["size", quick, full])
    count = lambda df, stage: df.agg(F.lit(stage).alias("stage"), F.count("*").alias("n"))
    return count(eligible, "eligible").union(count(first, "same_size")).union(count(second, "same_quick")).union(
        count(third, "same_full")
    ).union(count(third.select("size", quick, full).distinct(), "groups"))
