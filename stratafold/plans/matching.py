"""What copying one folder tree into another would do, and whether it has been done, from inventories.

The same decisions as those of ``execution``, as DataFrames over whole trees: nothing is
read or written but the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions import paths


def below(files: DataFrame, root: str, hash_column: str = "full_hash") -> DataFrame:
    """relative, size, h of the files under a root."""
    rows = files.filter(paths.under(F.col("path"), F.lit(root)))
    return rows.select(paths.relative(F.col("path"), F.lit(root)).alias("relative"), "size", F.col(hash_column).alias("h"))


def copy_plan(files: DataFrame, source: str, target: str, hash_column: str = "full_hash") -> DataFrame:
    """relative, size, action of every source file: 'copy' where the target has none, 'same' where it has its content, else 'conflict'.

    Content is the same if size and hash are; a hash that is not known matches nothing.
    """
    theirs = below(files, target, hash_column).select("relative", F.col("size").alias("there"), F.col("h").alias("other"))
    rows = below(files, source, hash_column).join(theirs, "relative", "left")
    same = F.coalesce((F.col("size") == F.col("there")) & (F.col("h") == F.col("other")), F.lit(False))
    return rows.select("relative", "size", F.when(F.col("there").isNull(), "copy").when(same, "same").otherwise("conflict").alias("action"))


def copy_totals(planned: DataFrame) -> DataFrame:
    """files_copied, bytes_copied, conflicts, verification_passed of a copy plan once it is carried out."""
    copied = F.col("action") == "copy"
    conflicts = F.sum(F.when(F.col("action") == "conflict", 1).otherwise(0))
    return planned.agg(
        F.sum(copied.cast("long")).alias("files_copied"), F.coalesce(F.sum(F.when(copied, F.col("size"))), F.lit(0)).alias("bytes_copied"),
        conflicts.alias("conflicts"), (conflicts == 0).alias("verification_passed"),
    )
