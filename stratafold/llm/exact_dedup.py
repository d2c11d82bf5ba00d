"""Exact dedup by counting quotient filters.

Two texts are equal when they are identical without white space (``[\\x20\\x09-\\x0D]``).
Every task counts the 64-bit fingerprints of its rows in counting quotient filters, one for
each region of the fingerprint space (its leading bits). The filters of a region merge
without loss by their sorted remainders. Only rows whose fingerprint counts more than one
are routed on, to be verified by their bytes: their texts are grouped by the whole text.
Of equal texts the row with the most code points in the original text stays, then the one
with the smallest doc_id.

Scale: what leaves a task before the filters are merged is the filters; a fingerprint that a
third of all rows hold is one entry with a count in each. A region's merge is bounded by
FINGERPRINTS_A_REGION. Texts with a fingerprint of their own are not shuffled as long as the
repeated fingerprints are few enough to be broadcast (counted first), and shuffled once
beyond that. Equal texts of one task are one row before the shuffle. The keys that more than
a thousandth of the rows share are joined by broadcast (``skew``).

Defined results: null counts as empty, so null, empty and blank texts are one group; rows
without doc_id come after those with one; of rows that agree in doc_id and code points one
stays, all others are dropped; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.quotient import CountingQuotientFilter
from stratafold.llm.text import BLANK
from stratafold.operators.skew import heavy_join
from stratafold.scratch import discard, materialize

#: Fingerprints that the filters of one region hold, about; regions are a power of two, at least LEAST_REGIONS.
FINGERPRINTS_A_REGION, LEAST_REGIONS = 1 << 20, 16
#: Rows a task holds before it writes its filters out.
ROWS_A_FILTER = 1 << 20
#: Repeated fingerprints (16 bytes each) that are joined by broadcast.
FEW_REPEATED = 1 << 20
FILTERS, REPEATED = "region long, filter binary", "fp long, n long"


def normal(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fp, text_sha256, points (code points of the original text), row (tells rows apart)."""
    rows = docs.select("doc_id", normal(F.col("text")).alias("normal"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"))
    return rows.select("doc_id", F.xxhash64("normal").alias("fp"), F.sha2("normal", 256).alias("text_sha256"), "points", F.monotonically_increasing_id().alias("row"))


def filters(rows: DataFrame, region_bits: int) -> DataFrame:
    """region, filter: what every task has counted of the column fp."""
    low = 64 - region_bits

    def written(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.sort(np.concatenate(held))
        regions = (values >> np.uint64(low)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, regions[1:] != regions[:-1]))
        rest = values & np.uint64((1 << low) - 1)
        out = [CountingQuotientFilter.of(part, None, low).dumps() for part in np.split(rest, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(regions[cuts], pa.int64()), pa.array(out, pa.binary())], names=["region", "filter"])

    def count(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= ROWS_A_FILTER:
                yield from written(held)
                held, n = [], 0
        if n:
            yield from written(held)

    return rows.select("fp").mapInArrow(count, FILTERS)


def repeated(rows: DataFrame, n_rows: int) -> DataFrame:
    """fp, n of the fingerprints that count more than one, from the merged filters."""
    bits = (max(LEAST_REGIONS, n_rows // FINGERPRINTS_A_REGION) - 1).bit_length()

    def merge(table: pa.Table) -> pa.Table:
        region = table.column("region")[0].as_py()
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.loads(x.as_py()) for x in table.column("filter")])
        values, counts = whole.items()
        many = counts > 1
        fp = (values[many] | np.uint64(region << (64 - bits))).view(np.int64)
        return pa.table({"fp": pa.array(fp, pa.int64()), "n": pa.array(counts[many], pa.int64())})

    return filters(rows, bits).groupBy("region").applyInArrow(merge, REPEATED)


def verified(docs: DataFrame, many: DataFrame, few: bool, n_rows: int) -> DataFrame:
    """fp, text_sha256, held of every different text among the rows with a repeated fingerprint, told apart by their bytes."""
    rows = docs.select(normal(F.col("text")).alias("normal")).withColumn("fp", F.xxhash64("normal"))
    rows = rows.join(F.broadcast(many.select("fp")), "fp") if few else heavy_join(rows, many, ["fp"], "n", n_rows)
    same = rows.groupBy("fp", "normal").agg(F.count("*").alias("held"))
    return same.select("fp", F.sha2("normal", 256).alias("text_sha256"), "held")


def dedup(docs: DataFrame, few_repeated: int = FEW_REPEATED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = materialize(digests(docs), "digests")
    n = rows.count()
    many = materialize(repeated(rows, n), "repeated")
    few = many.count() <= few_repeated
    routed = rows.join(F.broadcast(many.select("fp")), "fp") if few else heavy_join(rows, many, ["fp"], "n", n)
    order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = routed.groupBy("fp", "text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("stays"))
    # As many rows of each text as of its digest: else two texts would share a digest.
    groups = groups.join(verified(docs, many, few, n), ["fp", "text_sha256"]).withColumn(
        "group_size", F.when(F.col("held") == F.col("group_size"), F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a digest")).cast("long"))
    )
    groups = materialize(groups.filter("group_size > 1").select("fp", "text_sha256", "group_size", F.col("stays.doc_id").alias("keep_id"), F.col("stays.row").alias("keep_row")), "copies")
    discard(many)
    on, hot = ["fp", "text_sha256"], F.col("group_size") > max(1, n // 1000)
    heavy, light = groups.filter(hot), groups.filter(~hot)
    of_hot = rows.join(F.broadcast(heavy), on)
    others = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light.hint("merge"), on, "left")
    alone = F.col("group_size").isNull()
    return of_hot.unionByName(others).select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
    )


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    return r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal, length(coalesce(text, '')) as points from documents),
r as (select doc_id, sha256(normal) as text_sha256, count(*) over (partition by normal) as group_size,
  row_number() over w as place, first_value(doc_id) over w as keep_id
  from d window w as (partition by normal order by points desc, doc_id nulls last rows between unbounded preceding and unbounded following))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from r
"""
