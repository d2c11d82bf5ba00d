"""The folder tree: folders of an inventory, direct and recursive totals, filters.

Recursive figures explode each file's ancestors and aggregate once; the factor is the depth
of the tree, and partial aggregation keeps the shuffle at one row per task and folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions import paths


def folders(files: DataFrame, least_parts: int = 2) -> DataFrame:
    """path, parent, drive, depth, file_count, total_bytes (direct) of all folders and their ancestors."""
    direct = files.groupBy("folder").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_bytes"))
    every = files.select("folder").distinct().select(F.explode(paths.ancestors(F.col("folder"), least_parts)).alias("path")).distinct()
    out = every.join(direct.withColumnRenamed("folder", "path"), "path", "left").na.fill(0, ["file_count", "total_bytes"])
    return out.select(
        "path", F.when(paths.n_parts(F.col("path")) > least_parts, paths.parent(F.col("path"))).alias("parent"),
        paths.drive(F.col("path")).alias("drive"), (paths.n_parts(F.col("path")) - least_parts).alias("depth"),
        "file_count", "total_bytes",
    )


def with_ancestors(files: DataFrame, least_parts: int = 2) -> DataFrame:
    """The files, once for every folder above them (column ``ancestor``)."""
    return files.withColumn("ancestor", F.explode(paths.ancestors(F.col("folder"), least_parts)))


def subtree_totals(files: DataFrame, least_parts: int = 2) -> DataFrame:
    """ancestor, total_files, total_bytes of everything below each folder."""
    return with_ancestors(files, least_parts).groupBy("ancestor").agg(F.count("*").alias("total_files"), F.sum("size").alias("total_bytes"))


def lineage(folder_rows: DataFrame, least_parts: int = 2) -> DataFrame:
    """(ancestor, path) for every proper ancestor."""
    return folder_rows.select("path", F.explode(paths.ancestors(F.col("path"), least_parts, itself=False)).alias("ancestor"))


def active_files(files: DataFrame, folder_rows: DataFrame, hashes: DataFrame, least: int = 0) -> DataFrame:
    """Files that are not missing, in folders that are not, of at least a size, with their hashes if known."""
    rows = files.filter((F.col("size") >= least) & ~F.col("is_missing"))
    rows = rows.join(folder_rows.filter(~F.col("is_missing")).select(F.col("path").alias("folder")), "folder")
    return rows.join(hashes, "path", "left")


def allowed(files: DataFrame, folders_out=(), suffixes_out=(), least: int = 0, most: int | None = None) -> DataFrame:
    """Scan filters: no excluded folder above (exact names), no excluded suffix, size within bounds."""
    rows = files.filter(F.col("size") >= least)
    rows = rows if most is None else rows.filter(F.col("size") <= most)
    if suffixes_out:
        rows = rows.filter(~paths.suffix(F.col("filename")).isin(*suffixes_out))
    if folders_out:
        rows = rows.filter(~F.arrays_overlap(F.split("folder", "/"), F.array(*map(F.lit, folders_out))))
    return rows


def top_suffixes(files: DataFrame, k: int = 5) -> DataFrame:
    """folder, suffix, files, place: the k commonest suffixes of each folder, ties by suffix."""
    counts = files.groupBy("folder", paths.suffix(F.col("filename")).alias("suffix")).agg(F.count("*").alias("files"))
    place = F.row_number().over(W.partitionBy("folder").orderBy(F.desc("files"), "suffix"))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


#: Roots up to which each file is tested against all of them where it stands.
FEW_ROOTS = 64


def large_files(files: DataFrame, thresholds: DataFrame) -> DataFrame:
    """path, size of the files that reach the threshold of some root above them, each once.

    ``thresholds`` (root, threshold) has a row per configured root. Few of them, as is usual,
    become one expression over the path; more are joined on the folders above each file
    that reaches the smallest threshold.
    """
    few = thresholds.limit(FEW_ROOTS + 1).collect()
    if len(few) <= FEW_ROOTS:
        over = F.lit(False)
        for r in few:
            over = over | (paths.under(F.col("folder"), F.lit(r["root"])) & (F.col("size") >= r["threshold"]))
        return files.filter(over).select("path", "size").distinct()
    smallest = thresholds.agg(F.min("threshold").alias("__smallest"))  # one row
    files = files.crossJoin(F.broadcast(smallest)).filter("size >= __smallest")
    above = files.select("path", "size", F.explode(paths.ancestors(F.col("folder"), 1)).alias("root"))
    return above.join(thresholds, "root").filter("size >= threshold").select("path", "size").distinct()


def marked_totals(large: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """files, bytes of the large files, or of those whose path is among the marks of a review."""
    rows = large if marks is None else large.join(marks.select("path").distinct(), "path", "left_semi")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def distinct_errors(errors: DataFrame) -> DataFrame:
    """kind, path, message once each, without the codes that mean access was refused or a path is gone."""
    return errors.filter("code is null or code not in (2, 3, 5)").dropDuplicates(["kind", "path", "message"]).drop("code")
