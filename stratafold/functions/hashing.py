"""Content hashes: XXH128 of files, and md5 columns that SQL can check."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.ordering import by_weight

EDGE = 4096
CHUNK = 1 << 20
#: Bytes that one task reads, bytes of a part, bytes from which a file is hashed in parts, and what opening a file counts for.
TASK_BYTES, PART_BYTES, WHOLE_BYTES, FILE_COST = 1 << 30, 256 << 20, 1 << 30, 64 << 10
#: What the full hash of a file hashed in parts begins with.
IN_PARTS = "parts-"


def quick_hash(path: str) -> str:
    """XXH128 of the first and last EDGE bytes and the size in decimal."""
    size = os.stat(path).st_size
    state = xxhash.xxh3_128()
    with open(path, "rb") as f:
        state.update(f.read(EDGE))
        if size > EDGE:
            f.seek(max(size - EDGE, 0))
            state.update(f.read(EDGE))
    state.update(str(size).encode())
    return state.hexdigest()


def full_hash(path: str) -> str:
    """XXH128 of the whole file, a chunk at a time."""
    state = xxhash.xxh3_128()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            state.update(chunk)
    return state.hexdigest()


def part_hash(path: str, lo: int, hi: int) -> str:
    """XXH128 of a range of a file."""
    state = xxhash.xxh3_128()
    with open(path, "rb") as f:
        f.seek(lo)
        while lo < hi and (chunk := f.read(min(CHUNK, hi - lo))):
            state.update(chunk)
            lo += len(chunk)
    return state.hexdigest()


def _hashed(rows: DataFrame, digest: Callable[..., str], arguments: list[str]) -> DataFrame:
    """The rows with digest, error; an unreadable file has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for values in zip(*(pdf[a] for a in arguments)):
                try:
                    out.append((digest(*values), None))
                except OSError as e:
                    out.append((None, e.strerror or str(e)))
            yield pdf.assign(digest=[d for d, _ in out], error=[e for _, e in out])

    return rows.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", digest string, error string")


def hash_files(files: DataFrame, kind: str) -> DataFrame:
    """path, digest, error for files (path; size, else it is looked up) on storage that every executor mounts; an unreadable file has an error.

    Files are dealt to tasks by the bytes that are read of them. A file of more than
    WHOLE_BYTES is hashed in parts by many tasks; its full hash, marked as such, is that of
    its parts' hashes, so such files are compared with each other alone, as their sizes say.
    """
    if kind == "quick":
        rows = files.select("path", F.lit(2 * EDGE + FILE_COST).alias("cost"))
        return _hashed(by_weight(rows, ["path"], "cost", TASK_BYTES), quick_hash, ["path"]).drop("cost")
    rows = files if "size" in files.columns else _hashed(files.select("path"), lambda path: str(os.stat(path).st_size), ["path"]).select("path", F.coalesce(F.col("digest").cast("long"), F.lit(0)).alias("size"))
    rows = rows.select("path", "size", (F.col("size") + FILE_COST).alias("cost"))
    whole = by_weight(rows.filter(F.col("size") <= WHOLE_BYTES), ["path"], "cost", TASK_BYTES)
    whole = _hashed(whole.select("path"), full_hash, ["path"])
    last = F.ceil(F.col("size") / F.lit(PART_BYTES)).cast("long") - 1
    large = rows.filter(F.col("size") > WHOLE_BYTES)
    if large.isEmpty():
        return whole
    parts = large.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    parts = parts.select("path", "part", (F.col("part") * PART_BYTES).alias("lo"), F.least((F.col("part") + 1) * PART_BYTES, F.col("size")).alias("hi"))
    parts = by_weight(parts.withColumn("cost", F.col("hi") - F.col("lo") + FILE_COST), ["path", "part"], "cost", TASK_BYTES)
    done = _hashed(parts.drop("cost"), part_hash, ["path", "lo", "hi"]).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("parts"), F.max("error").alias("error")
    )
    joined = F.concat(F.lit(IN_PARTS), F.md5(F.array_join("parts.digest", "")))
    return whole.unionByName(done.select("path", F.when(F.col("error").isNull(), joined).alias("digest"), "error"))


def is_current(size: Column, digest: Column) -> Column:
    """Whether a stored full hash is of the kind that a file of this size gets now."""
    return digest.isNull() | (digest.startswith(IN_PARTS) == (size > WHOLE_BYTES))


def quick_md5(content: Column, size: Column) -> Column:
    """The quick hash over a binary column, by md5."""
    head = F.substr(content, F.lit(1), F.lit(EDGE))
    tail = F.when(size > EDGE, F.substr(content, F.greatest(size - EDGE, F.lit(0)) + 1, F.lit(EDGE))).otherwise(F.lit(b""))
    return F.md5(F.concat(head, tail, F.encode(size.cast("string"), "utf-8")))
