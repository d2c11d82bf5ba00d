"""Clusters of similar folders: numbering, master, unique files, suppression, change of master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions import paths
from stratafold.functions.sizes import fixed, human
from stratafold.operators import tree
from stratafold.operators.components import connected_components
from stratafold.operators.ordering import with_running


def clusters(pairs: DataFrame) -> DataFrame:
    """(cluster_id, path) of the components of the pairs, numbered by their first path."""
    found = connected_components(pairs.select(F.col("folder_a").alias("a"), F.col("folder_b").alias("b")))
    firsts = with_running(found.select("component").distinct(), ["component"])
    firsts = firsts.withColumn("cluster_id", F.format_string("cluster-%04d", F.col("place") + 1))
    return found.join(firsts, "component").select("cluster_id", F.col("node").alias("path"))


def least_scores(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """cluster_id, min_score over the pairs inside each cluster."""
    best = pairs.groupBy("folder_a", "folder_b").agg(F.max("score").alias("score"))
    inside = best.join(members.withColumnRenamed("path", "folder_a"), "folder_a")
    return inside.groupBy("cluster_id").agg(F.min("score").alias("min_score"))


def masters(members: DataFrame, folder_rows: DataFrame, roots: list[str]) -> DataFrame:
    """The members with is_master: earliest root, then most files, shallowest, newest, smallest path.

    Members without a folder row count as no files, depth 9999, time 0.
    """
    stats = folder_rows.select("path", "file_count", "total_bytes", "depth", "mtime")
    rows = members.join(stats, "path", "left")
    rank = F.lit(len(roots))
    for i, root in reversed(list(enumerate(roots))):
        rank = F.when(paths.under(F.col("path"), F.lit(root)), i).otherwise(rank)
    order = W.partitionBy("cluster_id").orderBy(
        rank, F.coalesce("file_count", F.lit(0)).desc(), F.coalesce("depth", F.lit(9999)), F.coalesce("mtime", F.lit(0.0)).desc(), "path"
    )
    return rows.withColumn("is_master", F.row_number().over(order) == 1).select(
        "cluster_id", "path", "is_master",
        F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
    )


def unique_files(mastered: DataFrame, files: DataFrame, hash_column: str = "full_hash") -> DataFrame:
    """cluster_id, copy, path, size: files under a copy whose hash is null or not under the master."""
    below = tree.with_ancestors(files).select("ancestor", "path", "size", F.col(hash_column).alias("h"))
    of = mastered.select("cluster_id", "is_master", F.col("path").alias("ancestor")).join(below, "ancestor")
    held = of.filter("is_master and h is not null").select("cluster_id", "h").distinct()
    copies = of.filter("not is_master")
    # A hash is null for every file the funnel settled early: such rows match nothing and need no shuffle.
    rest = copies.filter("h is not null").join(held, ["cluster_id", "h"], "left_anti")
    return rest.unionByName(copies.filter("h is null")).select("cluster_id", F.col("ancestor").alias("copy"), "path", "size")


def suppressed(members: DataFrame) -> DataFrame:
    """cluster_id of the clusters all of whose members lie below members of one other cluster.

    One pass is enough: a cluster that covers another is shallower, and covering carries over.
    """
    size = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    above = members.select("cluster_id", "path", F.explode(paths.ancestors(F.col("path"), 1, itself=False)).alias("ancestor"))
    cover = above.join(members.select(F.col("path").alias("ancestor"), F.col("cluster_id").alias("by")), "ancestor")
    met = cover.filter("by <> cluster_id").groupBy("cluster_id", "by").agg(F.count_distinct("path").alias("met"))
    return met.join(size, "cluster_id").filter("met = n").select("cluster_id").distinct()


def next_master(mastered: DataFrame) -> DataFrame:
    """The members with the mastership moved to the next path, from the last to the first."""
    by = W.partitionBy("cluster_id")
    rows = mastered.withColumn("i", F.row_number().over(by.orderBy("path")) - 1).withColumn("n", F.count("*").over(by))
    rows = rows.withColumn("at", F.max(F.when(F.col("is_master"), F.col("i"))).over(by))
    return rows.withColumn("is_master", F.col("i") == (F.col("at") + 1) % F.col("n")).drop("i", "n", "at")


def labels(mastered: DataFrame, scores: DataFrame) -> DataFrame:
    """cluster_id, label: one line per cluster for lists."""
    per = mastered.groupBy("cluster_id").agg(
        F.sum("total_bytes").alias("bytes"), F.max(F.when(F.col("is_master"), F.col("path"))).alias("master")
    ).join(scores, "cluster_id")
    return per.select(
        "cluster_id",
        F.format_string("· [%s] %-22s %8s", fixed(F.col("min_score"), 2), F.substring(paths.name(F.col("master")), 1, 22), human(F.col("bytes"))).alias("label"),
    )
