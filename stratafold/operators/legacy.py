"""The older analysis: plain Jaccard over case-sensitive signatures, file pairs, reports."""

from __future__ import annotations

from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions import scoring
from stratafold.operators import tree
from stratafold.plans import xlsx


def allowed(files: DataFrame, suffixes_out=(), least: int = 0, most: int = 0) -> DataFrame:
    """The older filters: suffixes as they are written, and no upper limit where it is 0."""
    last = F.regexp_extract("filename", r"[^.](\.[^.]+)$", 1)
    rows = files.filter((F.col("size") >= least) & ~last.isin(*suffixes_out)) if suffixes_out else files.filter(F.col("size") >= least)
    return rows.filter(F.col("size") <= most) if most else rows


def unchanged(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Folders whose time is the one stored: they are not read again."""
    return listing.join(state.select("path", F.col("mtime").alias("stored")), "path").filter("mtime = stored").drop("stored")


def signatures(files: DataFrame) -> DataFrame:
    """(folder, key): distinct name and size of whole subtrees, names as they are."""
    rows = files.select("folder", F.concat_ws("|", "filename", F.col("size").cast("string")).alias("key"))
    return tree.with_ancestors(rows).select(F.col("ancestor").alias("folder"), "key").distinct()


def dirty(folder_rows: DataFrame) -> DataFrame:
    """Folders never analysed, or scanned after they were."""
    return folder_rows.filter("analysed_at is null or scanned_at > analysed_at")


def mark_analysed(folder_rows: DataFrame, when) -> DataFrame:
    stale = F.col("analysed_at").isNull() | (F.col("scanned_at") > F.col("analysed_at"))
    return folder_rows.withColumn("analysed_at", F.when(stale, when).otherwise(F.col("analysed_at")))


def similar(keys: DataFrame, dirty_folders: DataFrame, threshold: float, cap: int = 100) -> DataFrame:
    """folder_a, folder_b, jaccard, shared: pairs with a dirty side at or above the threshold.

    The ratio of the set sizes bounds the Jaccard similarity and is checked before the join.
    """
    sizes = keys.groupBy("folder").agg(F.count("*").alias("n"))
    useful = keys.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c").between(2, cap)).select("key")
    held = keys.join(useful, "key").join(dirty_folders.select(F.col("path").alias("folder"), F.lit(True).alias("d")), "folder", "left")
    a, b = (held.select("key", F.col("folder").alias(f"folder_{s}"), F.coalesce("d", F.lit(False)).alias(f"d_{s}")) for s in "ab")
    pairs = a.join(b, "key").filter("folder_a < folder_b and (d_a or d_b)").select("folder_a", "folder_b").distinct()
    pairs = pairs.filter(~F.col("folder_b").startswith(F.concat("folder_a", F.lit("/"))))
    of = lambda s: sizes.select(F.col("folder").alias(f"folder_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = pairs.join(of("a"), "folder_a").join(of("b"), "folder_b")
    pairs = pairs.filter(scoring.ratio(F.col("n_a"), F.col("n_b")) >= threshold)
    side = lambda s: keys.withColumnRenamed("folder", f"folder_{s}")
    met = pairs.join(side("a"), "folder_a").join(side("b"), ["folder_b", "key"]).groupBy("folder_a", "folder_b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    met = met.withColumn("jaccard", scoring.jaccard(F.col("shared"), F.col("n_a"), F.col("n_b")))
    return met.filter(F.col("jaccard") >= threshold).select("folder_a", "folder_b", "jaccard", "shared")


def replace_results(old: DataFrame, new: DataFrame, dirty_folders: DataFrame) -> DataFrame:
    """Old results that touch no dirty folder, and the new ones."""
    gone = dirty_folders.select("path")
    kept = old.join(gone.withColumnRenamed("path", "folder_a"), "folder_a", "left_anti")
    kept = kept.join(gone.withColumnRenamed("path", "folder_b"), "folder_b", "left_anti")
    return kept.unionByName(new)


def file_pairs(results: DataFrame, files: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """folder_a, folder_b, filename, size, path_a, path_b, h_a, h_b of direct files alike in name and size."""
    side = lambda s: files.select(F.col("folder").alias(f"folder_{s}"), "filename", "size", F.col("path").alias(f"path_{s}"), F.col("h").alias(f"h_{s}"))
    rows = results.select("folder_a", "folder_b", "jaccard").join(side("a"), "folder_a").join(side("b"), ["folder_b", "filename", "size"])
    return rows if done is None else rows.join(done.select("path_a", "path_b"), ["path_a", "path_b"], "left_anti")


def confirm(pairs: DataFrame, quick=lambda c: F.substring(c, 1, 8)) -> DataFrame:
    """The pairs with quick_match, and full_match where the quick hashes agree (else null)."""
    rows = pairs.withColumn("quick_match", quick(F.col("h_a")) == quick(F.col("h_b")))
    return rows.withColumn("full_match", F.when(F.col("quick_match"), F.col("h_a") == F.col("h_b")))


def summary(stats: DataFrame, results: DataFrame, matches: DataFrame) -> DataFrame:
    """root, folders, files, similar_pairs, duplicate_files, duplicate_gb, and scanned_folders, scanned_files where ``stats`` has them; roots match as bare prefixes.

    A folder is cut to the length of every root, whatever their number, and joined on what is left.
    """
    of = stats.select("root")
    pairs = _of_roots(results, of).groupBy("root").agg(F.count("*").alias("similar_pairs"))
    dups = _of_roots(matches.filter("full_match"), of).groupBy("root").agg(
        F.count("*").alias("duplicate_files"), (F.sum("size") / 1e9).alias("duplicate_gb")
    )
    scanned = [c for c in ("scanned_folders", "scanned_files") if c in stats.columns]
    return stats.join(pairs, "root", "left").join(dups, "root", "left").na.fill(0, ["similar_pairs", "duplicate_files"]).na.fill(0.0, ["duplicate_gb"]).select(
        "root", "folders", "files", *scanned, "similar_pairs", "duplicate_files", "duplicate_gb"
    )


def _of_roots(rows: DataFrame, of: DataFrame) -> DataFrame:
    """The rows once for every root that folder_a begins with."""
    # As many as roots have different lengths: no more than a path can be long.
    lengths = [r[0] for r in of.select(F.length("root")).distinct().collect()]
    if not lengths:
        return rows.withColumn("root", F.lit("")).limit(0)
    cut = F.array_distinct(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.substr("folder_a", F.lit(1), n)))
    return rows.withColumn("root", F.explode(cut)).join(of, "root")


def similar_folders(results: DataFrame, folder_rows: DataFrame, matches: DataFrame) -> DataFrame:
    """The similar pairs with both folders' direct figures and what is confirmed between them."""
    side = lambda s: folder_rows.select(F.col("path").alias(f"folder_{s}"), F.col("file_count").alias(f"files_{s}"), F.col("total_bytes").alias(f"bytes_{s}"))
    met = matches.filter("full_match").groupBy("folder_a", "folder_b").agg(F.count("*").alias("confirmed_dups"), F.sum("size").alias("dup_bytes"))
    rows = results.join(side("a"), "folder_a").join(side("b"), "folder_b").join(met, ["folder_a", "folder_b"], "left")
    return rows.withColumn("confirmed_dups", F.coalesce("confirmed_dups", F.lit(0)))


#: The headings of the older workbook.
SUMMARY_HEADINGS = {
    "root": "Folder", "folders": "Total Folders", "files": "Total Files", "scanned_folders": "Scanned Folders", "scanned_files": "Scanned Files",
    "similar_pairs": "Similar Folder Pairs", "duplicate_files": "Duplicate Files", "duplicate_gb": "Duplicate GB",
}


def workbook(path: str, roots: DataFrame, pairs: DataFrame, folders: DataFrame) -> Path:
    """The older report: a summary of the roots, duplicate files by size, similar folders by duplicate bytes. Other sheets of an existing workbook stay."""
    sheet = lambda df, head=None: chain([head or df.columns], map(tuple, df.toLocalIterator()))
    return xlsx.update(path, {
        "Summary": sheet(roots.orderBy("root"), [SUMMARY_HEADINGS[c] for c in roots.columns]), "Duplicate Files": sheet(pairs.orderBy(F.desc("size"), "path_a", "path_b")),
        "Similar Folders": sheet(folders.orderBy(F.col("dup_bytes").desc_nulls_last(), "folder_a", "folder_b")),
    })
