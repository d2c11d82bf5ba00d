"""Reviewable proposals from scored pairs. Nothing acts without approval; nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions import paths
from stratafold.functions.scoring import BACKUP_TOKENS, looks_like_backup
from stratafold.operators.ordering import with_running

ACTIONS = ("keep", "mark_backup", "merge_folder", "move_folder", "needs_review")
STATES = ("pending", "approved", "rejected", "skipped")


def canonical(a: Column, b: Column, tokens=BACKUP_TOKENS) -> Column:
    """Of two folders the one to keep: not named like a backup, else the shallower, else the smaller path."""
    fa, fb = looks_like_backup(paths.name(a), tokens), looks_like_backup(paths.name(b), tokens)
    first = F.least(F.struct(paths.n_parts(a).alias("n"), a.alias("p")), F.struct(paths.n_parts(b).alias("n"), b.alias("p")))["p"]
    return F.when(fa & ~fb, b).when(fb & ~fa, a).otherwise(first)


def _filled(rows: DataFrame, action: Column) -> DataFrame:
    rows = rows.withColumn("action", action).withColumn("keep", canonical(F.col("folder_a"), F.col("folder_b")))
    other = F.when(F.col("keep") == F.col("folder_a"), F.col("folder_b")).otherwise(F.col("folder_a"))
    review = F.col("action") == "needs_review"
    rows = with_running(rows, [F.desc("score"), "folder_a", "folder_b"])
    # The texts of the reasons are required output.
    return rows.select(
        F.format_string("proposal-%04d", F.col("place") + 1).alias("proposal_id"), "action",
        F.when(review, F.array_sort(F.array("folder_a", "folder_b"))).otherwise(F.array(other)).alias("source_paths"),
        F.when(~review, F.col("keep")).alias("target_path"),
        F.when(review, F.concat(F.lit("Folder pair needs review before any move because evidence is mixed: "), "reason", F.lit(".")))
        .when(F.col("action") == "mark_backup", F.concat(F.lit("Folder looks like a backup copy of "), "keep", F.lit(" based on "), "reason", F.lit(".")))
        .otherwise(F.concat(F.lit("Folder contents strongly overlap and should be merged into "), "keep", F.lit("."))).alias("reason"),
        F.lit("pending").alias("approval_state"),
    )


def outside_clusters(tracked: DataFrame) -> DataFrame:
    """Proposals for backup and review pairs; pairs of the cluster track are left to the clusters."""
    return _filled(tracked.filter("track <> 'cluster'"), F.when(F.col("track") == "backup", "mark_backup").otherwise("needs_review"))


def pairwise(scored: DataFrame, merge: float) -> DataFrame:
    """Proposals for every pair, without clusters."""
    high = F.col("score") >= merge
    return _filled(scored, F.when(high & (F.col("name_bonus") > 0), "mark_backup").when(high, "merge_folder").otherwise("needs_review"))
