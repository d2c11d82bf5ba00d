"""Plans as tables and JSON, their review, and their execution by tasks that may be repeated."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratafold.plans import artifacts, execution, matching
from stratafold.sources import walk


def lay_out(root, tree):
    for name, content in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def written_plan(tmp_path, proposals, clusters):
    path = tmp_path / "plan-x.json"
    path.write_text(json.dumps({"plan_id": "x", "proposals": proposals, "clusters": clusters}))
    return path


def merge(name, sources, target, state="approved", action="merge_folder"):
    return {"proposal_id": name, "action": action, "source_paths": list(map(str, sources)), "target_path": target and str(target), "approval_state": state}


def results_of(path):
    return {r["proposal_id"]: r for r in artifacts.load(path)["proposal_results"]}


def test_proposals_and_clusters(spark, tmp_path):
    lay_out(tmp_path, {"a/n/f.txt": b"new", "a/g.txt": b"same", "m/g.txt": b"same", "b/g.txt": b"other", "e/empty": b""})
    os.symlink(tmp_path / "a/g.txt", tmp_path / "a/link.txt")
    member = lambda n, master, files: {"path": str(tmp_path / n), "is_master": master, "unique_files": [str(tmp_path / n / f) for f in files]}
    plan = written_plan(tmp_path, [
        merge("p1", [tmp_path / "a"], tmp_path / "t"), merge("p2", [], "z", action="mark_backup"), merge("p3", [tmp_path / "a"], tmp_path / "u", "pending"),
        merge("p4", [tmp_path / "a", tmp_path / "b", tmp_path / "e"], tmp_path / "v"), merge("p5", [tmp_path / "nowhere"], tmp_path / "w"), merge("p6", [tmp_path / "a"], None),
    ], [
        {"cluster_id": "c1", "status": "approved", "members": [member("m", True, []), member("a", False, ["n/f.txt"])]},
        {"cluster_id": "c2", "status": "approved", "members": [member("m", True, []), member("b", False, ["g.txt"]), member("e", False, [])]},
        {"cluster_id": "c3", "status": "approved", "members": [member("a", False, [])]},
        {"cluster_id": "c4", "status": "pending", "members": [member("m", True, []), member("a", False, ["g.txt"])]},
    ])
    done = execution.run_plan(spark, plan, tmp_path)
    results = results_of(done)
    assert list(results) == ["p1", "p2", "p4", "p5", "p6", "c1", "c2", "c3"]
    assert {k: r["status"] for k, r in results.items()} == {"p1": "completed", "p2": "skipped", "p4": "failed", "p5": "failed", "p6": "skipped", "c1": "completed", "c2": "failed", "c3": "failed"}
    assert (results["p1"]["files_copied"], results["p1"]["bytes_copied"], results["p1"]["verification_passed"]) == (3, 11, True)
    assert results["p2"]["verification_passed"] and not results["p6"]["verification_passed"] and not results["p4"]["source_cleanup_allowed"]
    # Of a and b, which both hold g.txt, a comes first; the empty file is copied too.
    assert (tmp_path / "v/g.txt").read_bytes() == b"same" and "different content" in results["p4"]["errors"][0] and (tmp_path / "v/empty").read_bytes() == b""
    assert results["p4"]["files_copied"] == 4 and (tmp_path / "m/n/f.txt").read_bytes() == b"new"
    marked = {n: (tmp_path / n / execution.MARKER).exists() for n in "abeu"}
    assert marked == {"a": True, "b": False, "e": True, "u": False}
    assert not [p for p in tmp_path.rglob(".stratafold-*.part")]
    rows = spark.read.parquet(artifacts.header(done)["rows"])
    assert rows.filter("status = 'conflict'").count() == 2
    again = results_of(execution.run_plan(spark, plan, tmp_path))
    assert again["p1"]["status"] == "completed" and again["p1"]["files_copied"] == 1  # the marker


def test_results_equal_the_copy_plan(spark, tmp_path, monkeypatch):
    """What was foretold from two inventories is what happens, with files of many parts and tasks."""
    monkeypatch.setattr(execution, "PART_BYTES", 1000)
    monkeypatch.setattr(execution, "TASK_BYTES", 200_000)
    lay_out(tmp_path, {f"s/{i % 7}/f{i}": bytes([i % 251]) * (i * 37) for i in range(120)} | {f"t/{i % 7}/f{i}": bytes([i % 251]) * (i * 37 + i % 2) for i in range(0, 120, 5)})
    os.utime(tmp_path / "s/1/f1", (1000, 1000))
    hashed = walk.below(spark.createDataFrame([(str(tmp_path / n),) for n in "st"], "path string")).filter("kind = 'file'").withColumn("full_hash", F.md5(F.concat("size", (F.col("size") % 37).cast("string"))))
    planned = matching.copy_plan(hashed, str(tmp_path / "s"), str(tmp_path / "t")).collect()
    totals = matching.copy_totals(spark.createDataFrame(planned)).first()
    assert execution.verify_tree(spark, str(tmp_path / "s"), str(tmp_path / "t")) is False
    results = execution.copy_tree(spark, str(tmp_path / "s"), str(tmp_path / "t"))
    names = {"copied": "copy", "same": "same", "conflict": "conflict"}
    done = {r["source"].removeprefix(f"{tmp_path}/s/"): (r["size"], names[r["status"]]) for r in results.collect()}
    assert done == {r["relative"]: (r["size"], r["action"]) for r in planned}
    assert results.filter("status = 'copied'").agg(F.count("*"), F.sum("size")).first()[:] == (totals["files_copied"], totals["bytes_copied"])
    assert results.filter("status = 'conflict'").count() == totals["conflicts"] > 0
    for name, (_, action) in done.items():
        if action == "copy":
            assert (tmp_path / "t" / name).read_bytes() == (tmp_path / "s" / name).read_bytes()
    assert os.stat(tmp_path / "t/1/f1").st_mtime == 1000
    execution.copy_tree(spark, str(tmp_path / "s"), str(tmp_path / "u"))
    assert execution.verify_tree(spark, str(tmp_path / "s"), str(tmp_path / "u")) is True


KILLED = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from stratafold.plans import execution
root = sys.argv[1]
execution.PART_BYTES, execution.TASK_BYTES = 1000, 150_000
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", root + "/shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
real = execution._copy_part
def dies_midway(source, hidden, lo, hi):
    error = real(source, hidden, lo, hi)
    if TaskContext.get().attemptNumber() == 0 and lo >= 3000:
        open(root + "/killed", "a").write("x")
        os._exit(9)
    return error
tasks = execution.tree_tasks(spark.createDataFrame([("tree", 0, root + "/s", root + "/t")], "entry string, rank long, unit string, to string"))
print("RESULT", sorted((r["status"], r["n"], r["b"]) for r in execution.carried_out(tasks, dies_midway).groupBy("status").agg({"size": "sum", "*": "count"}).toDF("status", "b", "n").collect()))
"""


def test_a_task_killed_midway_is_harmless(tmp_path):
    lay_out(tmp_path, {f"s/f{i}": os.urandom(4500) for i in range(6)})
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parent.parent)}
    ran = subprocess.run([sys.executable, "-c", KILLED, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "RESULT [('copied', 6, 27000)]" in ran.stdout, ran.stdout + ran.stderr[-2000:]
    assert (tmp_path / "killed").exists()
    assert {p.name: p.read_bytes() for p in (tmp_path / "t").iterdir()} == {p.name: p.read_bytes() for p in (tmp_path / "s").iterdir()}


def test_commit_may_be_repeated(tmp_path):
    lay_out(tmp_path, {"s": b"x" * 10, "h": b"x" * 10, "taken": b"y" * 10})
    s, h, t = (str(tmp_path / n) for n in ("s", "h", "t"))
    assert execution._commit(s, h, t, 10) == ("copied", None) and not os.path.exists(h)
    assert execution._commit(s, h, t, 10) == ("copied", None)  # the attempt before got as far as the name
    lay_out(tmp_path, {"h": b"x" * 10})
    assert execution._commit(s, h, t, 10) == ("copied", None) and not os.path.exists(h)  # or not as far as the hidden file
    lay_out(tmp_path, {"h": b"x" * 10})
    assert execution._commit(s, h, str(tmp_path / "taken"), 10)[0] == "conflict" and (tmp_path / "taken").read_bytes() == b"y" * 10
    lay_out(tmp_path, {"h": b"x" * 9})
    assert execution._commit(s, h, str(tmp_path / "t2"), 10)[0] == "failed" and not os.path.exists(h)


@pytest.fixture
def plan(spark, tmp_path):
    mastered = spark.createDataFrame([("c1", "d/A", True, 2, 20), ("c1", "d/B", False, 3, 30), ("c2", "A", True, 0, 0), ("c2", "B", False, 0, 0)], "cluster_id string, path string, is_master boolean, file_count long, total_bytes long")
    scores = spark.createDataFrame([("c1", 0.80004), ("c2", 1.0)], "cluster_id string, min_score double")
    unique = spark.createDataFrame([("c1", "d/B", f"d/B/{i:03d}", 1) for i in range(20)], artifacts.UNIQUE_FILES)
    proposals = spark.createDataFrame([("p1", "merge_folder", ["x", "y"], "z", 'a "status": "approved"', "pending"), ("p2", "needs_review", ["x"], None, "b", "pending")], artifacts.PROPOSALS)
    return artifacts.write_plan(tmp_path, proposals, artifacts.plan_tables(mastered, scores, scores.filter("cluster_id = 'c2'").select("cluster_id"), unique), 3, 2)


def test_json_is_the_tables(spark, plan):
    data = artifacts.load(plan)
    assert plan.read_text() == json.dumps(data, indent=2) + "\n"
    assert artifacts.header(plan) == {k: v for k, v in data.items() if k not in ("proposals", "clusters")} and artifacts.is_current(artifacts.header(plan), 3, 2)
    assert [(c["cluster_id"], c["min_score"], c["is_suppressed"], [(m["path"], m["unique_file_count"], len(m["unique_files"])) for m in c["members"]]) for c in data["clusters"]] == [
        ("c2", 1.0, True, [("A", 0, 0), ("B", 0, 0)]), ("c1", 0.8, False, [("d/A", 0, 0), ("d/B", 20, 20)])]
    assert [(p["proposal_id"], p["source_paths"], p["target_path"]) for p in data["proposals"]] == [("p1", ["x", "y"], "z"), ("p2", ["x"], None)]


def test_states_edited_in_the_json_count(spark, plan):
    plan.write_text(plan.read_text().replace('"approval_state": "pending"', '"approval_state": "approved"', 1).replace('"status": "pending"', '"status": "rejected"', 1))
    tables = artifacts.Plan.of(spark, plan)
    assert {r["proposal_id"]: r["approval_state"] for r in tables.read("proposals").collect()} == {"p1": "approved", "p2": "pending"}
    assert tables.status_counts() == {"pending": 1, "rejected": 1}
    plan.write_text(plan.read_text().replace('"status": "rejected"', '"status": "maybe"'))
    with pytest.raises(ValueError):
        artifacts.Plan.of(spark, plan)


def test_review(spark, plan):
    tables = artifacts.Plan.of(spark, plan)
    text = "\n".join(artifacts.detail_text(cluster, members) for cluster, members in tables.nested(hidden_too=False, most_files=15))
    assert "[keeps] d/A (2 files, 0.0 KB)" in text and "[copy] d/B (3 files, 0.0 KB, 20 found nowhere else)" in text and text.count("    + ") == 16 and "+ 5 others" in text
    files = spark.createDataFrame([("d/A", "d/A/x", 1, "1"), ("d/B", "d/B/x", 1, "1"), ("d/B", "d/B/y", 1, None), ("d/B", "d/B/z", 1, "2")], "folder string, path string, size long, full_hash string")
    held = lambda: {m["path"]: (m["is_master"], m["unique_file_count"], list(f)) for c, ms in tables.nested() if c["cluster_id"] == "c1" for m, f in ms}
    tables.cycle_master("c1", files)
    assert held() == {"d/A": (False, 0, []), "d/B": (True, 0, [])}
    tables.cycle_master("c1", files)
    assert held() == {"d/A": (True, 0, []), "d/B": (False, 2, ["d/B/y", "d/B/z"])}
    tables.set_status("c1", "approved")
    assert tables.status_counts() == {"pending": 1, "approved": 1}
    with pytest.raises(ValueError):
        tables.set_status("c1", "maybe")
