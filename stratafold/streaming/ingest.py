"""Listings as a stream: new Parquet files of a folder become snapshots, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators import snapshot


def start(spark: SparkSession, source: str, schema, store: snapshot.SnapshotStore, checkpoint: str):
    """A query that upserts each batch into the store; run with what is there, then stop.

    Each batch is a delta, so what is written grows with the batch. One that is repeated
    after a failure gives the same rows again. The store's key tells the rows apart.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        store.upsert(snapshot.latest_rows(batch.withColumn("__epoch", F.lit(epoch)), store.key, "__epoch").drop("__epoch"))

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_activity(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total per hour of event time, with a watermark for late rows."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )
