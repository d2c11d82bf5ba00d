"""Inventories derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators import tree


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, filename, path, size, h: three drives that hold overlapping copies of the documents."""
    base = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.format_string("doc_%d.%s", "doc_id", "lang").alias("filename"), F.col("n_chars").alias("size"),
        F.md5("text").alias("h"), F.substring("source", 4, 9).cast("int").alias("sn"),
    )
    mirror = F.when(F.col("sn") % 2 == 0, F.lit("_backup")).otherwise(F.lit(""))
    place = lambda top, more=F.lit(""): F.concat(F.lit(top), "source", more, F.lit("/"), "lang")
    # One pass over the documents: each is put on the drives that hold it.
    drives = F.array(
        F.lit("D"), F.when(F.expr("doc_id % (2 + sn) <> 0 and sn % 5 <> 4"), "E"), F.when(F.expr("sn % 3 = 0 and doc_id % (5 + sn) <> 0"), "F")
    )
    rows = base.withColumn("drive", F.explode(F.array_compact(drives))).withColumn(
        "folder", F.when(F.col("drive") == "D", place("D:/corpus/")).when(F.col("drive") == "E", place("E:/corpus/", mirror)).otherwise(place("F:/archive/"))
    )
    return rows.select("folder", "filename", F.concat_ws("/", "folder", "filename").alias("path"), "size", "h")


def timed_folders(files: DataFrame) -> DataFrame:
    """The folders of an inventory of the tables, with a time made up from their size."""
    return tree.folders(files).withColumn("mtime", (F.col("total_bytes") % 1009).cast("double"))


def cluttered_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, path, size: a drive with caches, temporary folders and ordinary projects."""
    i, k = F.col("doc_id") % 9, F.col("doc_id") % 4
    folder = (
        F.when(i == 0, F.lit("C:/Windows/Temp"))
        .when(i == 1, F.concat(F.lit("C:/Users/u"), k, F.lit("/AppData/Local/Temp")))
        .when(i == 2, F.concat(F.lit("C:/proj/"), "source", F.lit("/node_modules/pkg"), k))
        .when(i == 3, F.concat(F.lit("C:/proj/"), "source", F.lit("/node_modules/pkg/__pycache__")))
        .when(i == 4, F.lit("D:/Windows.old"))
        .when(i == 5, F.lit("D:/a/Windows.old"))
        .when(i == 6, F.concat(F.lit("C:/Users/u"), k, F.lit("/AppData/Local/Google/Chrome/User Data/Default/Cache_Data")))
        .when(i == 7, F.concat(F.lit("C:/proj/"), "source", F.lit("/.Venv/lib/"), "lang"))
        .otherwise(F.concat(F.lit("C:/proj/"), "source", F.lit("/src")))
    )
    return table(spark, sf_dir, "documents").select(folder.alias("folder"), F.col("n_chars").alias("size"), "doc_id").select(
        "folder", F.concat("folder", F.lit("/f"), "doc_id").alias("path"), "size"
    )
