from stratafold.operators.snapshot import SnapshotStore
from stratafold.sources.tables import table
from stratafold.streaming import ingest


def test_stream_becomes_snapshots(spark, tmp_path):
    schema = "path string, size long"
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for rows in ([("a", 1), ("b", 2)], [("b", 3)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.start(spark, str(tmp_path / "in"), schema, store, str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 3)}


def test_hourly_activity_alike_in_batch_and_stream(spark, tmp_path):
    events = table(spark, "/root/testdata/sf0.001", "events")
    events.write.parquet(str(tmp_path / "ev"))
    stream = ingest.hourly_activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda rows: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 6)) for r in rows)
    assert key(spark.table("hourly").collect()) == key(ingest.hourly_activity(events).collect())
