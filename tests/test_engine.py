import json
import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from stratafold import catalog, cli
from stratafold.engine import Engine, space_check
from stratafold.functions import hashing
from stratafold.operators import legacy
from stratafold.operators.ordering import by_weight
from stratafold.plans import artifacts, xlsx
from stratafold.sources import walk
from stratafold.sources.config import load_config


def lay_out(root, tree):
    for name, content in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


@pytest.fixture
def setup(tmp_path):
    root = tmp_path / "data"
    two = {"readme.txt": b"same text in four", "data.bin": b"0123456789012345678901234567890"}
    lay_out(root, {f"{d}/{n}": c for d in ("projectA", "projectA/docs", "projectB", "projectB/docs") for n, c in two.items()} | {"misc/other.txt": b"x" * 47, "skip/me.txt": b"no"})
    config = tmp_path / "scan.yml"
    config.write_text(
        f"roots:\n  - path: {root}\nhome_folder: {tmp_path}/out\ndatabase_filename: db\nexclude_folders: [skip]\nduplicate_size_threshold: 1B\n"
        "similarity_threshold: 0.2\nmerge_threshold: 0.95\nsimilarity_cluster_threshold: 0.7\nlarge_file_size: 40\n"
    )
    return root, config


def test_whole_run(spark, setup, tmp_path, capsys):
    root, config = setup
    assert cli.main(["--config", str(config)], spark) == 0
    engine = Engine(spark, load_config(config))
    assert sorted((r["size_bytes"], r["file_count"], r["total_bytes"]) for r in engine.duplicates().collect()) == [(17, 4, 68), (31, 4, 124)]
    pairs = engine.similarity().collect()
    assert len(pairs) == 4 and all(abs(r["score"] - 0.9) < 1e-9 for r in pairs)
    plan = artifacts.load(artifacts.latest(tmp_path / "out", "plan"))
    assert plan["proposals"] == [] and [len(c["members"]) for c in plan["clusters"]] == [4]
    assert all(m["unique_file_count"] == 0 for m in plan["clusters"][0]["members"])
    assert [r["size"] for r in engine.largest().collect()] == [47]
    with zipfile.ZipFile(tmp_path / "out" / "report.xlsx") as z:
        assert "Similarity" in z.read("xl/workbook.xml").decode() and len([n for n in z.namelist() if "worksheets" in n]) == 5
    assert engine.scan() == 1  # known roots are not listed again
    (root / "misc/other.txt").unlink()
    assert engine.scan(rescan=True) == 2
    assert engine.active_files().count() == 8 and engine.stores["files"].read().filter("is_missing").count() == 1
    assert str(engine.plan()) == str(artifacts.latest(tmp_path / "out", "plan"))


def test_config_errors_and_older_keys(tmp_path):
    path = tmp_path / "c.yml"
    for text in ("[]", "roots: [x]", "roots: [{size: 1}]", "database_path: /d", f"folders: [{tmp_path}]"):
        path.write_text(text)
        with pytest.raises(ValueError):
            load_config(path)
    path.write_text(f"folders: [{tmp_path}]\ndatabase: {{path: /d/x}}\nanalysis: {{similarity_threshold: 0.5}}\nscan_filters: {{exclude_extensions: [.TMP]}}\nscan_max_age: 2w\n")
    config = load_config(path)
    assert (config.similarity_threshold, config.exclude_extensions, config.scan_max_age_days, config.database) == (0.5, frozenset({".tmp"}), 14, "/d/x")


def test_space_and_shortcuts(tmp_path):
    assert space_check([50_000 * 10], 4000)[0] == "abort" and space_check([50_000 * 10], 8000)[0] == "warn" and space_check([10], 100) == ("ok", 0, 0)
    rows = [{"path": "C:/u/v/a:b", "category": "dev_cache", "size_bytes": 2048, "requires_review": True}, {"path": "C:/x", "category": "user_temp", "size_bytes": 9000, "requires_review": False}]
    assert artifacts.write_shortcuts(rows, tmp_path) == 2 and artifacts.write_shortcuts(rows[:1], tmp_path) == 1
    assert [p.name for p in tmp_path.glob("*.url")] == ["001 2.0 KB (review) dev_cache u v a_b.url"]


def test_workbook(tmp_path):
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    path = xlsx.write(tmp_path / "w.xlsx", {"One": iter([("h",), (True,), ("<&",), (None,), (2.5,)]), "Two": []}, most_rows=3)
    with zipfile.ZipFile(path) as z:
        parts = [ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")) for i in (1, 2, 3)]
        names = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if s.tag.endswith("}sheet")]
    texts = [["".join(c.itertext()) for c in p.iter() if c.tag.endswith("}c")] for p in parts]
    assert names == ["One", "One 2", "Two"] and texts == [["h", "1", "<&"], ["h", "", "2.5"], []]


def test_delta_scan_errors_and_statistics(spark, setup):
    root, config = setup
    engine = Engine(spark, load_config(config), (said := []).append)
    assert engine.scan() == 1 and walk.count_folders(spark, [str(root)], {"skip"}) == 6
    stats = engine.scan_stats().first()
    assert (stats["run_id"], stats["total_folders"], stats["total_files"], stats["indexed_folders"], stats["indexed_files"]) == (1, 6, 9, 6, 9)
    # An edit inside an unchanged folder is not seen, a new file is; everything else moves to the run.
    (root / "projectA/data.bin").write_bytes(b"other")
    os.utime(root / "projectA", (1, 1))
    (root / "misc/new.txt").write_bytes(b"new")
    (root / "projectB/docs/readme.txt").unlink()
    assert engine.scan(delta=True) == 2
    files = {r["path"].removeprefix(f"{root}/"): r for r in engine.stores["files"].read().collect()}
    assert files["misc/new.txt"]["run_id"] == 2 and files["projectA/data.bin"]["size"] == 31 and files["projectA/data.bin"]["run_id"] == 2
    assert [p for p, r in files.items() if r["is_missing"]] == ["projectB/docs/readme.txt"]
    assert engine.scan_stats().first()["indexed_folders"] < 6 and any(x.startswith("level 1: 0 of ") for x in said)
    listing = walk.walk(spark, [str(root)])
    gone = listing.filter("kind = 'folder'").limit(1).withColumn("path", F.lit(str(root / "nowhere"))).withColumn("changed", F.lit(True))
    errors = gone.select("path", "depth", "root", "changed").mapInPandas(lambda it: walk._list(it, frozenset()), walk.LISTING).collect()
    assert [(r["kind"], r["what"]) for r in errors] == [("error", "folder")] and errors[0]["message"]


def test_scan_ends_early_without_space(spark, setup, monkeypatch):
    root, config = setup
    engine = Engine(spark, load_config(config))
    monkeypatch.setattr("stratafold.engine.LEAST_FREE", 1 << 60)
    with pytest.raises(walk.Stopped):
        engine.scan()
    monkeypatch.undo()
    assert engine.scan_stats().count() == 0 and engine.scan() == 1 and engine.active_files().count() == 9


def test_walk_stops_inside_a_level(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "FOLDERS_A_TASK", 2)
    lay_out(tmp_path, {f"{i:02d}/f{k}": b"x" for i in range(24) for k in range(2)})
    said = []

    def stop(level, done, folders):
        said.append((level, done, folders))
        return "enough" if level == 1 and done >= 8 else None

    with pytest.raises(walk.Stopped) as stopped:
        walk.walk(spark, [str(tmp_path)], tasks=2, before_batch=stop)
    done = said[-1][1]
    assert said[0] == (0, 0, 1) and 8 <= done < 24 and len({d for level, d, _ in said if level == 1}) >= 2
    listing = stopped.value.listing
    assert listing.filter("kind = 'read'").count() == 1 + done and listing.filter("kind = 'file'").count() == 2 * done
    assert walk.walk(spark, [str(tmp_path)], tasks=2).filter("kind = 'file'").count() == 48


def test_a_large_folder_is_passed_on_in_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "ROWS_A_BATCH", 10)
    lay_out(tmp_path, {f"f{k}": b"" for k in range(95)} | {"d/x": b""})
    folders = walk.pd.DataFrame([(str(tmp_path), 0, "r", True), (str(tmp_path / "no"), 0, "r", True), (str(tmp_path / "d"), 1, "r", False)], columns=["path", "depth", "root", "changed"])
    frames = list(walk._list(iter([folders]), frozenset()))
    assert max(map(len, frames)) <= 10 and len(frames) >= 10
    kinds = walk.pd.concat(frames)["kind"].value_counts().to_dict()
    assert kinds == {"file": 95, "folder": 1, "read": 1, "error": 1, "unchanged": 1}


def test_files_are_hashed_by_bytes_and_large_ones_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hashing, "TASK_BYTES", 100_000)
    monkeypatch.setattr(hashing, "FILE_COST", 1000)
    monkeypatch.setattr(hashing, "PART_BYTES", 1000)
    monkeypatch.setattr(hashing, "WHOLE_BYTES", 50_000)
    tree = {f"s{i}": bytes([i % 5]) * (i % 5 * 100) for i in range(40)} | {"b1": b"z" * 90_000, "b2": b"z" * 90_000, "b3": b"z" * 89_999 + b"y"}
    lay_out(tmp_path, tree)
    files = spark.createDataFrame([(str(tmp_path / n), len(c)) for n, c in tree.items()] + [(str(tmp_path / "gone"), 5), (str(tmp_path / "gone2"), 60_000)], "path string, size long")
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in hashing.hash_files(files, "full").collect()}
    assert len(rows) == len(tree) + 2 and rows["gone"]["error"] and rows["gone2"]["digest"] is None and rows["gone2"]["error"]
    groups = {}
    for n in tree:
        groups.setdefault(rows[n]["digest"], set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(n for n in tree if tree[n] == c) for c in set(tree.values()))
    assert rows["b1"]["digest"].startswith(hashing.IN_PARTS) and rows["s1"]["digest"] == hashing.full_hash(str(tmp_path / "s1"))
    dealt = by_weight(files.withColumn("cost", F.col("size") + 1000), ["path"], "cost", 100_000).groupBy(F.spark_partition_id()).agg(F.sum("cost").alias("cost"))
    assert 2 <= dealt.count() <= 6 and dealt.agg(F.max("cost")).first()[0] <= 100_000 + 91_000
    stored = spark.createDataFrame([(10, "aa"), (60_000, "aa"), (60_000, "parts-aa"), (60_000, None)], "size long, h string")
    assert [r[0] for r in stored.select(hashing.is_current(F.col("size"), F.col("h"))).collect()] == [True, False, True, True]


def test_what_waste_and_largest_see_is_written_back(spark, setup):
    root, config = setup
    lay_out(root, {"projectA/.tox/x.bin": b"y" * 2048, "projectA/.tox/gone.bin": b"y" * 10})
    engine = Engine(spark, load_config(config))
    engine.scan()
    (root / "misc/other.txt").write_bytes(b"x" * 60)
    (root / "projectA/.tox/gone.bin").unlink()
    assert {os.path.basename(r["path"]): r["size"] for r in engine.largest().collect()} == {"other.txt": 60, "x.bin": 2048}
    assert [(r["size_bytes"], r["file_count"]) for r in engine.waste().collect()] == [(2048, 1)]
    stored = {os.path.basename(r["path"]): r for r in engine.stores["files"].read().collect()}
    assert stored["other.txt"]["size"] == 60 and stored["gone.bin"]["is_missing"] and not stored["x.bin"]["is_missing"]
    runs = engine.stores["files"].current()
    engine.largest().count()
    assert engine.stores["files"].current() == runs  # nothing has changed, nothing is written


def test_review_and_waste_commands(spark, setup, tmp_path, capsys):
    root, config = setup
    lay_out(root, {"projectA/.tox/x.bin": b"y" * 2048, "Windows.old/z.bin": b"z" * 4096})
    assert cli.main(["--config", str(config)], spark) == 0
    plan = artifacts.load(artifacts.latest(tmp_path / "out", "plan"))
    cluster = plan["clusters"][0]
    old = [m["path"] for m in cluster["members"] if m["is_master"]]
    assert cli.main(["--config", str(config), "merge-review", "--cluster", cluster["cluster_id"], "--cycle", "--status", "approved"], spark) == 0
    now = artifacts.load(artifacts.latest(tmp_path / "out", "plan"))["clusters"][0]
    assert [m["path"] for m in now["members"] if m["is_master"]] != old and now["status"] == "approved"
    assert cli.main(["--config", str(config), "waste"], spark) == 0
    said = capsys.readouterr().out
    assert "Can go: 2.0 KB in 1 folders" in said and ".tox" in said and "Together: 2.0 KB" in said


def test_legacy_workbook_and_filters(spark, tmp_path):
    files = spark.createDataFrame([("a", "x.TMP", 5), ("a", "y.tmp", 50), ("a", ".tmp", 9)], "folder string, filename string, size long")
    assert {r["filename"] for r in legacy.allowed(files, (".tmp",)).collect()} == {"x.TMP", ".tmp"}
    assert legacy.allowed(files, (), 6, 0).count() == 2 and legacy.allowed(files, (), 0, 10).count() == 2
    state = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, mtime double")
    assert [r["path"] for r in legacy.unchanged(spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "path string, mtime double"), state).collect()] == ["a"]
    queries = catalog.queries()
    of = lambda name: queries[name](spark, "/root/testdata/sf0.001")
    path = legacy.workbook(str(tmp_path / "old.xlsx"), of("legacy_summary"), of("legacy_duplicates"), of("legacy_similar_folders"))
    with zipfile.ZipFile(path) as z:
        assert [f'name="{n}"' in z.read("xl/workbook.xml").decode() for n in ("Summary", "Duplicate Files", "Similar Folders")] == [True] * 3


def sheets_of(path):
    """Of every sheet by name the texts of its cells, row by row."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == len(set(z.namelist()))
        main, out = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", {}
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        types = {e.get("PartName") for e in ElementTree.fromstring(z.read("[Content_Types].xml"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            assert f"/xl/{target}" in types
            rows = ElementTree.fromstring(z.read(f"xl/{target}")).iter(f"{main}row")
            out[sheet.get("name")] = [["".join(c.itertext()) for c in r] for r in rows]
        return out


def test_workbook_is_updated_in_place(tmp_path):
    path = tmp_path / "w.xlsx"
    xlsx.update(path, {"Mine & own": [("h",), (1,)], "Foreign": [("note",), ("kept",)]})
    with zipfile.ZipFile(path, "a") as z:
        z.writestr("xl/theme/theme1.xml", "<t/>")
    xlsx.update(path, {"Mine & own": [("h",), (1,), (2,), (3,)], "Added": [("x",)]}, most_rows=3)
    assert sheets_of(path) == {"Foreign": [["note"], ["kept"]], "Mine & own": [["h"], ["1"], ["2"]], "Mine & own 2": [["h"], ["3"]], "Added": [["x"]]}
    xlsx.update(path, {"Mine & own": [("h",)]})
    assert sheets_of(path) == {"Foreign": [["note"], ["kept"]], "Added": [["x"]], "Mine & own": [["h"]]}
    with zipfile.ZipFile(path) as z:
        assert z.read("xl/theme/theme1.xml") == b"<t/>"


def test_older_analysis(spark, setup, tmp_path, capsys):
    root, config = setup
    engine = Engine(spark, load_config(config))
    engine.scan()
    assert cli.main(["--config", str(config), "older"], spark) == 0
    path = tmp_path / "out/older.xlsx"
    book = sheets_of(path)
    assert book["Summary"][0] == ["Folder", "Total Folders", "Total Files", "Scanned Folders", "Scanned Files", "Similar Folder Pairs", "Duplicate Files", "Duplicate GB"]
    similar = {tuple(x.removeprefix(f"{root}/") for x in r[:2]) for r in book["Similar Folders"][1:]}
    assert ("projectA", "projectB") in similar and book["Summary"][1][1:5] == ["6", "9", "6", "9"]
    assert len(book["Duplicate Files"]) > 1 and all(r[2] in ("readme.txt", "data.bin") for r in book["Duplicate Files"][1:])
    xlsx.update(path, {"Notes": [("mine",)]})
    # Only what was scanned since is analysed again; here a copy that now differs.
    (root / "projectB/data.bin").write_bytes(b"9" * 31)
    engine.scan(rescan=True)
    engine.older()
    again = sheets_of(path)
    assert again["Notes"] == [["mine"]] and len(again["Duplicate Files"]) < len(book["Duplicate Files"])
