"""The data source of folders: batches, streams that stop and go on, large folders in pieces."""

import json

from stratafold.sources import listing, walk


def lay_out(root):
    for i in range(6):
        for k in range(3):
            d = root / f"a{i}" / f"b{k}" / "c"
            d.mkdir(parents=True)
            (d / "deep.txt").write_text("x" * i)
            (root / f"a{i}" / f"f{k}").write_text("y")
    (root / "skip").mkdir()
    (root / "skip/no.txt").write_text("n")


def rows(df):
    return sorted((r["kind"], r["path"], r["depth"], r["size"], r["root"]) for r in df.collect() if r["kind"] in ("file", "read"))


def test_batch_lists_the_named_folders(spark, tmp_path):
    lay_out(tmp_path)
    spark.dataSource.register(listing.FolderSource)
    roots = [str(tmp_path / f"a{i}") for i in range(3)] + [str(tmp_path / "gone")]
    df = spark.read.format("folders").option("roots", json.dumps(roots)).option("folders_a_task", "2").load()
    got = df.groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == {"read": 3, "folder": 9, "file": 9} and df.rdd.getNumPartitions() == 2


def test_stream_stops_and_goes_on(spark, tmp_path):
    root, state, out, ck = tmp_path / "data", tmp_path / "state", str(tmp_path / "out"), str(tmp_path / "ck")
    root.mkdir()
    lay_out(root)
    spark.dataSource.register(listing.FolderSource)

    def start():
        df = spark.readStream.format("folders").option("roots", json.dumps([str(root), str(root / "a1")])).option("state", str(state)).option("excluded", '["skip"]').option("folders_a_task", "4").load()
        return df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()

    query = start()
    while not query.lastProgress:  # stopped after its first levels
        query.awaitTermination(1)
    query.stop()
    query = start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.read.parquet(out)) == rows(walk.walk(spark, [str(root)], {"skip"}))


def test_a_split_may_be_read_again(tmp_path, monkeypatch):
    lay_out(tmp_path / "data")
    monkeypatch.setattr(walk, "ROWS_A_BATCH", 5)
    stream = listing.FolderStream({"roots": json.dumps([str(tmp_path / "data")]), "state": str(tmp_path / "state"), "folders_a_task": "2"})
    assert stream.initialOffset() == {"level": 0} == stream.initialOffset() and stream.latestOffset() == {"level": 1}
    (root,) = stream.partitions({"level": 0}, {"level": 1})
    partial = stream.read(root)
    next(partial)
    partial.close()  # a task that is lost leaves no folders behind
    assert stream.latestOffset() == {"level": 1}
    for _ in range(2):
        batches = list(stream.read(root))
        assert max(b.num_rows for b in batches) <= 5 and sum(b.num_rows for b in batches) == 8
    assert stream.latestOffset() == {"level": 2}
    splits = stream.partitions({"level": 1}, {"level": 2})
    assert [s.hi - s.lo for s in splits] == [2, 2, 2, 1]
