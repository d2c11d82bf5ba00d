"""Row numbers and running sums over a whole table, without one task that holds it.

The table is dealt into ranges of the order; each range is summed, the sums of the ranges
before it (one row per range) are added to what a window inside the range gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.scratch import materialize


def with_running(df: DataFrame, order: list[Column | str], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with place, the number of rows before each, and for every new: column of ``sums`` the sum over the rows before.

    ``order`` must tell all rows apart. An empty table gives no rows.
    """
    sums = sums or {}
    table = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    parts = table.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{new}") for new, c in sums.items()])
    # One row per range: as many as there are shuffle partitions, whatever the table holds.
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ["__n", *[f"__{new}" for new in sums]]])
    inside = W.partitionBy("__part").orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    table = table.join(F.broadcast(starts), "__part").withColumn("place", F.col("__n") + F.row_number().over(inside) - 1)
    for new, c in sums.items():
        table = table.withColumn(new, F.col(f"__{new}") + F.coalesce(F.sum(c).over(before), F.lit(0)))
    return table.drop("__part", "__n", *[f"__{new}" for new in sums])


def by_weight(df: DataFrame, order: list[Column | str], weight: str, per_task: int) -> DataFrame:
    """``df`` dealt to partitions of about ``per_task`` of a weight column, in runs of the order.

    No partition holds more than that and the weight of one row. ``order`` must tell all
    rows apart.
    """
    rows = with_running(df, order, {"__before": weight}).drop("place")
    rows = rows.withColumn("__task", F.floor(F.col("__before") / F.lit(per_task)).cast("int"))
    tasks = (rows.agg(F.max("__task")).first()[0] or 0) + 1
    return rows.repartitionById(tasks, F.col("__task")).drop("__before", "__task")
