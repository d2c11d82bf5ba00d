"""Merge-on-read tables: equal to the rewrite, deltas as large as the change, joins of bucketed bases without a shuffle."""

import random

from pyspark.sql import functions as F

from stratafold.operators import snapshot
from stratafold.operators.snapshot import SnapshotStore
from stratafold.scratch import size_of


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_deltas_equal_the_rewrite_through_compactions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SnapshotStore, "MOST_DELTAS", 3)
    store, rng = SnapshotStore(spark, str(tmp_path / "t"), buckets=2), random.Random(1)
    schema, whole, seen = "path string, size long, note string", {}, {}
    for run in range(1, 9):
        part = {f"p{rng.randrange(40)}": (rng.randrange(9), rng.choice([None, "x"])) for _ in range(12)}
        whole |= part
        assert store.upsert(spark.createDataFrame([(k, *v) for k, v in part.items()], schema)) >= run
        seen[store.current()] = dict(whole)
        assert rows(store.read()) == sorted((k, *v) for k, v in whole.items())
    newest = sorted(seen)[-2]
    assert rows(store.read(newest)) == sorted((k, *v) for k, v in seen[newest].items())
    assert sum(r["base"] == r["run"] for r in store._versions()) >= 2  # compacted at least once


def test_what_is_written_grows_with_the_change(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))
    big = spark.range(200_000).select(F.format_string("p%d", "id").alias("path"), F.xxhash64("id").alias("size"))
    store.write(big)
    store.upsert(spark.createDataFrame([("p7", 1), ("new", 2)], big.schema))
    assert size_of(spark, f"{store.path}/run=2") < size_of(spark, f"{store.path}/run=1") / 100
    assert store.read().count() == 200_001 and store.read().filter("path = 'p7'").first()["size"] == 1


def test_rows_of_trees_seen_whole_move_to_the_run(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))
    schema = "path string, run_id long, is_missing boolean"
    store.write(spark.createDataFrame([("a/x", 1, False), ("a/gone", 1, True), ("ab/x", 1, False), ("b/x", 1, False)], schema))
    store.upsert(spark.createDataFrame([("a/new", 2, False)], schema), {"a": 2})
    store.upsert(spark.createDataFrame([("b/x", 1, True)], schema), {"b": 3})
    assert rows(store.read()) == [("a/gone", 1, True), ("a/new", 2, False), ("a/x", 2, False), ("ab/x", 1, False), ("b/x", 1, True)]


def test_changed_rows(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", None, 1), ("c", 3, 1)], "path string, size long, run_id long")
    new = spark.createDataFrame([("a", 1, 2), ("b", None, 2), ("c", 4, 2), ("d", 5, 2)], old.schema)
    assert rows(snapshot.changed(new, old, "path", ("run_id",))) == [("c", 4, 2), ("d", 5, 2)]


def test_bucketed_bases_join_without_a_shuffle(spark, tmp_path):
    stores = [SnapshotStore(spark, str(tmp_path / n), buckets=4) for n in ("files", "hashes")]
    for store, step in zip(stores, (1, 3)):
        store.write(spark.range(0, 3000, step).select(F.format_string("p%d", "id").alias("path"), F.col("id").alias("v")))
    files, hashes = (s.read() for s in stores)
    joined = files.join(hashes.withColumnRenamed("v", "h").hint("merge"), "path", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.filter("h is not null").count() == 1000
    for store in stores:  # as another session finds them
        spark.sql(f"drop table {store._table(1)}")
    plan = stores[0].read().join(stores[1].read().hint("merge"), "path")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
