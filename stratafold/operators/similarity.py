"""Folder pairs that share content.

Folders meet over shared keys: signatures (lower-cased name and size) and hashes of
duplicated content, both of whole subtrees. A key that more than ``cap`` folders hold makes
no pairs, which is part of the definition, but still counts in the scores. ``close_pairs``
has no such cap: it finds every pair that can reach a high score.

Keys that the same folders hold are alike in all this, so they are merged to one that
carries their number: the joins of folder pairs grow with the different sets of folders,
not with the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions import paths, scoring
from stratafold.operators import duplicates, tree
from stratafold.operators.ordering import with_running
from stratafold.operators.skew import heavy_join
from stratafold.scratch import materialize

#: Folders that meet over one key are joined in blocks of about so many by all.
BLOCK = 1000


def folder_keys(files: DataFrame, least: int = 0) -> DataFrame:
    """(folder, kind, key), distinct, over whole subtrees; kind is 's' or 'h'."""
    marked = files.select("folder", F.concat_ws("|", F.lower("filename"), F.col("size").cast("string")).alias("key"), F.lit("s").alias("kind"))
    copies = duplicates.members(files, duplicates.groups(files, least)).select("folder", F.col("full_hash").alias("key"), F.lit("h").alias("kind"))
    return tree.with_ancestors(marked.union(copies)).select(F.col("ancestor").alias("folder"), "kind", "key").distinct()


def merged_keys(keys: DataFrame) -> DataFrame:
    """(folder, kind, key, signatures, hashes): of the keys that the same folders hold the first, with the number of each kind.

    Sets of folders are told apart by their size and 128 bits, which partial aggregation
    makes without holding a set.
    """
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "folder")).alias(f"x{seed}")
    sets = keys.groupBy("kind", "key").agg(F.count("*").alias("n"), bits(1), bits(2))
    firsts = sets.groupBy("n", "x1", "x2").agg(
        F.min(F.struct("kind", "key")).alias("k"), F.count_if(F.col("kind") == "s").alias("signatures"), F.count_if(F.col("kind") == "h").alias("hashes")
    )
    return keys.join(firsts.select("k.kind", "k.key", "signatures", "hashes"), ["kind", "key"]).select("folder", "kind", "key", "signatures", "hashes")


def _counted(keys: DataFrame) -> DataFrame:
    """The keys with signatures and hashes: how many keys of each kind a row stands for."""
    if "signatures" in keys.columns:
        return keys
    return keys.withColumn("signatures", (F.col("kind") == "s").cast("long")).withColumn("hashes", (F.col("kind") == "h").cast("long"))


def key_counts(keys: DataFrame) -> DataFrame:
    """folder, signatures, hashes: number of distinct keys of each kind; keys may be merged."""
    return _counted(keys).groupBy("folder").agg(F.sum("signatures").alias("signatures"), F.sum("hashes").alias("hashes"))


def candidate_pairs(keys: DataFrame, cap: int = 100) -> DataFrame:
    """(folder_a, folder_b), a < b, that share a key held by 2 to ``cap`` folders and are not one above the other; keys may be merged."""
    keys = keys.select("folder", "kind", "key")
    useful = keys.groupBy("kind", "key").agg(F.count("*").alias("n")).filter(F.col("n").between(2, cap)).select("kind", "key")
    held = keys.join(useful, ["kind", "key"])
    pairs = held.withColumnRenamed("folder", "folder_a").join(held.withColumnRenamed("folder", "folder_b"), ["kind", "key"])
    pairs = pairs.filter("folder_a < folder_b").select("folder_a", "folder_b").distinct()
    return pairs.filter(~F.col("folder_b").startswith(F.concat("folder_a", F.lit("/"))))


def pivots(keys: DataFrame, totals: DataFrame, least_ratio: float = 0.2, tokens=scoring.BACKUP_TOKENS) -> DataFrame:
    """(folder): of alike folders so many that pairs with one of them link whatever all pairs link; keys may be merged.

    Folders are alike that hold the same keys, as many files and bytes, and both or neither a
    backup's name: all their pairs with the folders of another such kind, or of their own, have
    one score; only those of which one lies above the other are none. Of one kind and depth at
    most c = 1 / least_ratio lie below a folder (each holds that part of its files) and one
    above it. So with 2c + 1 of a kind and depth as pivots, the two folders of a pair without
    any each make pairs with c + 1 pivots of the other's kind, and two of these make one.
    """
    bits = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "kind", "key")).alias(f"x{seed}")
    held = _counted(keys).groupBy("folder").agg(F.sum("signatures").alias("signatures"), F.sum("hashes").alias("hashes"), bits(1), bits(2))
    rows = held.join(totals.withColumnRenamed("ancestor", "folder"), "folder").withColumn("backup", scoring.looks_like_backup(paths.name(F.col("folder")), tokens))
    alike = ["signatures", "hashes", "x1", "x2", "total_files", "total_bytes", "backup"]
    place = F.row_number().over(W.partitionBy(*alike, paths.n_parts(F.col("folder"))).orderBy("folder"))
    return rows.withColumn("place", place).filter(F.col("place") <= 2 * int(1 / least_ratio) + 1).select("folder")


def close_pairs(keys: DataFrame, threshold: float, pivots: DataFrame | None = None) -> DataFrame:
    """(folder_a, folder_b), a < b and not one above the other: all pairs whose score can reach the threshold, over all keys; keys may be merged.

    Given pivots (folder), all such pairs of which one is a pivot.

    Whatever else two folders share, such a score takes a part t of their signatures. With
    every folder's signatures in one order, the rarest first, the first that two such folders
    share has at most 1 - t of either's before it, and enough of both behind it (prefix and
    positional filter). Folders meet over those only: a key that many folders hold is among
    them where a folder holds little else, and then makes its pairs like any other.
    """
    t = (threshold - scoring.HASH_WEIGHT - scoring.NAME_WEIGHT * scoring.NAME_BONUS) / scoring.SIGNATURE_WEIGHT
    if t <= 0:
        raise ValueError(f"pairs can reach a score of {threshold} without a common signature")
    keys = _counted(keys).filter("signatures > 0").select("folder", "kind", "key", "signatures")
    held = keys.groupBy("kind", "key").agg(F.count("*").alias("n"))
    # The place of a key in its folder is its place in the whole table less that of the folder's first.
    rows = materialize(with_running(keys.join(held, ["kind", "key"]), ["folder", "n", "kind", "key"], {"ahead": "signatures"}), "ranked")
    firsts = rows.groupBy("folder").agg(F.min("ahead").alias("start"), F.sum("signatures").alias("own"), F.count("*").alias("rows"))
    firsts = firsts.withColumn("pivot", F.lit(True)) if pivots is None else firsts.join(pivots.withColumn("pivot", F.lit(True)), "folder", "left")
    rows = heavy_join(rows, firsts, ["folder"], "rows", rows.count()).withColumn("rest", F.col("start") + F.col("own") - F.col("ahead"))
    slack = 1e-6  # for rounding; a pair too many is scored and dropped
    met = rows.filter((F.col("n") > 1) & (F.col("rest") >= t * F.col("own") - slack)).select("kind", "key", "folder", "own", "rest", "pivot")
    met = materialize(met, "met")
    blocks = met.filter("pivot").groupBy("kind", "key").agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"))
    met = met.join(blocks, ["kind", "key"])
    one = met.filter("pivot").withColumn("block", F.pmod(F.xxhash64("folder"), "blocks")).drop("blocks", "pivot")
    other = met.select("kind", "key", *[F.col(c).alias(f"{c}_2") for c in ("folder", "own", "rest", "pivot")], F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    enough = t / (1 + t) * (F.col("own") + F.col("own_2")) - slack
    once = (F.col("folder") < F.col("folder_2")) | (F.col("pivot_2").isNull() & (F.col("folder") > F.col("folder_2")))
    pairs = one.join(other, ["kind", "key", "block"]).filter(once & (F.least("rest", "rest_2") >= enough))
    pairs = pairs.select(F.least("folder", "folder_2").alias("folder_a"), F.greatest("folder", "folder_2").alias("folder_b")).distinct()
    return pairs.filter(~F.col("folder_b").startswith(F.concat("folder_a", F.lit("/"))))


def scores(pairs: DataFrame, keys: DataFrame, totals: DataFrame, threshold: float, least_ratio: float = 0.2, tokens=scoring.BACKUP_TOKENS) -> DataFrame:
    """The scored pairs at or above the threshold.

    The ratio filter on subtree totals (ancestor, total_files, total_bytes) comes before the
    intersection, which is the expensive join; keys may be merged.
    """
    keys = _counted(keys)
    side = lambda s: totals.select(F.col("ancestor").alias(f"folder_{s}"), F.col("total_files").alias(f"files_{s}"), F.col("total_bytes").alias(f"bytes_{s}"))
    rows = pairs.join(side("a"), "folder_a").join(side("b"), "folder_b").filter("files_a > 0 and files_b > 0")
    rows = rows.withColumn("file_count_ratio", scoring.ratio(F.col("files_a"), F.col("files_b"))).withColumn(
        "size_ratio", scoring.ratio(F.col("bytes_a"), F.col("bytes_b"))
    ).filter((F.col("file_count_ratio") >= least_ratio) & (F.col("size_ratio") >= least_ratio))
    rows = rows.select("folder_a", "folder_b", "file_count_ratio", "size_ratio")
    common = rows.select("folder_a", "folder_b").join(keys.withColumnRenamed("folder", "folder_a"), "folder_a").join(
        keys.select(F.col("folder").alias("folder_b"), "kind", "key"), ["folder_b", "kind", "key"]
    )
    shared = common.groupBy("folder_a", "folder_b").agg(
        F.sum("signatures").alias("shared_signatures"), F.sum("hashes").alias("shared_duplicate_files")
    )
    counts = key_counts(keys)
    of = lambda s: counts.select(F.col("folder").alias(f"folder_{s}"), F.col("signatures").alias(f"s_{s}"), F.col("hashes").alias(f"h_{s}"))
    rows = rows.join(shared, ["folder_a", "folder_b"]).join(of("a"), "folder_a").join(of("b"), "folder_b")
    rows = rows.withColumn("name_bonus", scoring.name_bonus(paths.name(F.col("folder_a")), paths.name(F.col("folder_b")), tokens))
    rows = rows.withColumn(
        "score",
        scoring.score(
            scoring.jaccard(F.col("shared_duplicate_files"), F.col("h_a"), F.col("h_b")),
            scoring.jaccard(F.col("shared_signatures"), F.col("s_a"), F.col("s_b")), F.col("name_bonus"),
        ),
    ).filter(F.col("score") >= threshold)
    return rows.withColumn("reason", scoring.reason(F.col("shared_duplicate_files"), F.col("shared_signatures"), F.col("name_bonus"))).select(
        "folder_a", "folder_b", "score", "shared_duplicate_files", "shared_signatures", "name_bonus", "size_ratio", "file_count_ratio", "reason"
    )


def tracks(scored: DataFrame, merge: float, cluster: float) -> DataFrame:
    """The scored pairs with their track: backup, cluster or review."""
    return scored.withColumn(
        "track",
        F.when((F.col("score") >= merge) & (F.col("name_bonus") > 0), "backup").when(F.col("score") >= cluster, "cluster").otherwise("review"),
    )
