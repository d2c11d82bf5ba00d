"""Folders that hold reclaimable data: temporary files, caches, old installations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.functions import paths
from stratafold.operators import tree

# What marks a folder, with category, description and whether it needs review.
TOP_NAMES = [
    ("WINDOWS.OLD", "old_windows", "Previous Windows installation", True),
    ("$WINDOWS.~BT", "old_windows", "Windows upgrade temporary files", True),
    ("$WINDOWS.~WS", "old_windows", "Windows upgrade temporary files", True),
    ("$RECYCLE.BIN", "recycle_bin", "Recycle bin contents", False),
]
PATTERNS = [
    ("/WINDOWS/TEMP$", "windows_temp", "Windows system temp folder", False),
    ("/WINDOWS/MINIDUMP$", "crash_dumps", "Windows crash mini-dumps", False),
    ("/WINDOWS/SOFTWAREDISTRIBUTION/DOWNLOAD$", "windows_update", "Windows Update download cache", False),
    ("/USERS/[^/]+/APPDATA/LOCAL/TEMP$", "user_temp", "User temp folder", False),
    ("/GOOGLE/CHROME/USER DATA/DEFAULT/CACHE", "browser_cache", "Chrome browser cache", False),
    ("/MICROSOFT/EDGE/USER DATA/DEFAULT/CACHE", "browser_cache", "Edge browser cache", False),
    ("/MOZILLA/FIREFOX/PROFILES/[^/]+/CACHE2$", "browser_cache", "Firefox browser cache", False),
    ("/MICROSOFT/WINDOWS/INETCACHE$", "browser_cache", "Internet Explorer cache", False),
    ("/MICROSOFT/WINDOWS/WER$", "app_cache", "Windows error reporting cache", False),
]
NAMES = [
    ("NODE_MODULES", "dev_cache", "Node.js package cache", False),
    ("__PYCACHE__", "dev_cache", "Python bytecode cache", False),
    (".PYTEST_CACHE", "dev_cache", "pytest cache", False),
    (".TOX", "dev_cache", "tox test environments", False),
    (".VENV", "dev_cache", "Python virtual environment", False),
    ("VENV", "dev_cache", "Python virtual environment", False),
    (".GRADLE", "dev_cache", "Gradle build cache", False),
    (".M2", "dev_cache", "Maven dependency cache", False),
]


def kind_of(path: Column) -> Column:
    """Struct of category, description, requires_review; null for ordinary folders. First match wins."""
    whole, last = F.upper(path), F.upper(paths.name(path))
    made = lambda c, d, r: F.struct(F.lit(c).alias("category"), F.lit(d).alias("description"), F.lit(r).alias("requires_review"))
    out = F.when(F.lit(False), made("", "", False))
    for text, *rest in TOP_NAMES:
        out = out.when((paths.n_parts(path) == 2) & (last == text), made(*rest))
    for pattern, *rest in PATTERNS:
        out = out.when(whole.rlike(pattern), made(*rest))
    for text, *rest in NAMES:
        out = out.when(last == text, made(*rest))
    return out


def candidates(files: DataFrame, least: int = 0) -> DataFrame:
    """path, category, description, requires_review, size_bytes, file_count.

    A folder below a marked one is part of it. Totals cover the whole subtree.
    """
    every = tree.folders(files, least_parts=2).select("path", kind_of(F.col("path")).alias("kind")).filter("kind is not null")
    nested = every.select("path", F.explode(paths.ancestors(F.col("path"), 2, itself=False)).alias("above")).join(
        every.select(F.col("path").alias("above")), "above"
    )
    top = every.join(nested.select("path").distinct(), "path", "left_anti")
    totals = tree.subtree_totals(files).select(F.col("ancestor").alias("path"), F.col("total_bytes").alias("size_bytes"), F.col("total_files").alias("file_count"))
    rows = top.join(totals, "path", "left").na.fill(0, ["size_bytes", "file_count"])
    rows = rows.filter(F.col("size_bytes") >= least) if least > 0 else rows
    return rows.select("path", "kind.category", "kind.description", "kind.requires_review", "size_bytes", "file_count")


def totals(found: DataFrame) -> DataFrame:
    """part ('all', 'review', 'safe'), folders, bytes."""
    part = F.explode(F.array(F.lit("all"), F.when(F.col("requires_review"), "review").otherwise("safe")))
    return found.select(part.alias("part"), "size_bytes").groupBy("part").agg(F.count("*").alias("folders"), F.sum("size_bytes").alias("bytes"))
