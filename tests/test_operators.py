import random

import pytest
from pyspark.sql import functions as F

from stratafold.operators import clusters as C
from stratafold.operators import duplicates, legacy, similarity, snapshot, tree, waste

FILES = "folder string, filename string, path string, size long, h string"


def files(spark, rows):
    return spark.createDataFrame([(f, n, f"{f}/{n}", s, h) for f, n, s, h in rows], FILES)


def test_waste_kinds(spark):
    folders = {
        "C:/Windows/Temp": "windows_temp", "C:/Users/x/AppData/Local/Temp": "user_temp", "C:/Windows.old": "old_windows", "D:/a/Windows.old": None,
        "C:/p/node_modules": "dev_cache", "C:/U/Google/Chrome/User Data/Default/Cache_Data": "browser_cache", "C:/$Recycle.Bin": "recycle_bin", "C:/p/src": None,
    }
    got = spark.createDataFrame([(p,) for p in folders], "p string").select("p", waste.kind_of(F.col("p"))["category"].alias("c")).collect()
    assert {r["p"]: r["c"] for r in got} == folders


def test_nested_waste_is_one(spark):
    rows = files(spark, [("C:/p/node_modules/q/__pycache__", "a", 5, "x"), ("C:/p/node_modules", "b", 7, "y"), ("C:/p/lib/.venv/m/venv", "c", 1, "z")])
    assert {(r["path"], r["size_bytes"], r["file_count"]) for r in waste.candidates(rows).collect()} == {("C:/p/node_modules", 12, 2), ("C:/p/lib/.venv", 1, 1)}


def test_ratio_and_cap_edges(spark):
    rows = [("D:/a/x", "f0", 10, "h")] + [("D:/a/y", f"f{i}", 10, "h" if i == 0 else f"k{i}") for i in range(5)]
    table = files(spark, rows)
    keys = similarity.folder_keys(table)
    kept = similarity.scores(similarity.candidate_pairs(keys), keys, tree.subtree_totals(table), 0.0)
    assert {(r["folder_a"], r["folder_b"]) for r in kept.collect()} == {("D:/a/x", "D:/a/y")}  # exactly 0.2 stays
    many = files(spark, [(f"D:/r{i}/x", "same", 1, "h") for i in range(3)])
    keys = similarity.folder_keys(many)
    assert similarity.candidate_pairs(keys, 6).count() > 0 and similarity.candidate_pairs(keys, 5).count() == 0


def test_keys_of_the_same_folders_are_merged(spark):
    """More files in the same folders make no more merged keys, and pairs and scores are those of all keys."""
    rng = random.Random(2)

    def table(n):
        rows = [(f"D:/c/{'ab'[i % 2]}", f"f{i}", 5, f"h{i}") for i in range(n)] + [(f"E:/c/{'ab'[i % 2]}", f"f{i}", 5, f"h{i}") for i in range(n) if i % 7]
        return files(spark, rows + [(f"F:/d{rng.randrange(4)}", f"g{rng.randrange(9)}", 3, f"k{rng.randrange(5)}") for _ in range(40)])

    def scored(keys, rows):
        kept = similarity.scores(similarity.candidate_pairs(keys, 6), keys, tree.subtree_totals(rows), 0.0)
        return sorted(map(str, kept.collect()))

    small, large = table(40), table(400)
    for rows in (small, large):
        keys = similarity.folder_keys(rows)
        merged = similarity.merged_keys(keys)
        assert scored(merged, rows) == scored(keys, rows) != []
        assert sorted(map(str, similarity.key_counts(merged).collect())) == sorted(map(str, similarity.key_counts(keys).collect()))
    own = lambda rows: similarity.merged_keys(similarity.folder_keys(rows.filter("filename like 'f%'"))).count()
    assert own(small) == own(large) < 40


@pytest.mark.parametrize("block", [3, 1000])
def test_close_pairs_are_all_pairs_of_a_high_score(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    rng = random.Random(4)
    rows = []
    for i in range(60):
        kind, folder = i % 6, f"{'DEF'[i % 3]}:/{rng.choice(['c', 'old'])}{rng.randrange(4)}/d{i}{rng.choice(['', '/e', ' copy'])}"
        own = [(f"x{i // 12}_{j}", j) for j in range(rng.randrange(4, 9))]
        rows += [(folder, f"f{name}", n + 1, f"h{name}") for name, n in own if rng.random() < 0.9]
        rows += [(folder, "license", 7, "l"), (folder, "notice", 7, "l")] * (kind > 1)
        rows += [(folder, f"own{i}", 2, None)] * (kind == 3) + [(folder, f"own{i}", 1, "one")] * (kind == 4)
    rows += [(f"G:/all/{i}{end}", "license", 7, "l") for i in range(40) for end in ("", "/sub")][::3]
    table = files(spark, rows)
    keys = similarity.folder_keys(table)
    scored = lambda pairs, keys, least: sorted(map(str, similarity.scores(pairs, keys, tree.subtree_totals(table), least).drop("reason").collect()))
    every = similarity.candidate_pairs(keys, 10**9)
    for least in (0.6, 0.7, 0.9):
        expected = scored(every, keys, least)
        assert scored(similarity.close_pairs(keys, least), keys, least) == expected != []
        merged = similarity.merged_keys(keys)
        assert scored(similarity.close_pairs(merged, least), merged, least) == expected
    assert 0 < similarity.close_pairs(keys, 0.7).count() < every.count() / 2


def test_pairs_of_pivots_link_what_all_pairs_link(spark):
    """Many alike folders, in chains and below folders that hold several of them."""
    rng = random.Random(5)
    sets = {"p": "abcd", "q": "abcde", "r": "abcf", "s": "xy"}
    rows, folders = [], 0
    for i in range(90):
        kind = rng.choice("pppqqrs")
        top = f"{'DE'[i % 2]}:/{rng.choice(['m', 'n'])}{i}"
        for j in range(rng.choice([1, 1, 1, 2, 3, 5, 6])):
            folder = top + f"/{j}" * (j > 0 or rng.random() < 0.5) + "".join(f"/{rng.choice(['in', 'old', 'z'])}" for _ in range(rng.randrange(4)))
            rows += [(folder, n, 10, f"h{n}") for n in sets[kind]]
    table = files(spark, rows).distinct()
    keys, totals = similarity.merged_keys(similarity.folder_keys(table)), tree.subtree_totals(table)

    def found(pairs):
        rows = similarity.tracks(similarity.scores(pairs, keys, totals, 0.7), 0.88, 0.7).filter("track = 'cluster'")
        members = C.clusters(rows)
        return sorted(map(tuple, members.collect())), sorted(map(str, C.least_scores(members, rows).collect())), rows.count()

    few = found(similarity.close_pairs(keys, 0.7, similarity.pivots(keys, totals)))
    every = found(similarity.candidate_pairs(keys, 10**9))
    assert few[:2] == every[:2] and len(few[1]) > 1
    assert few[2] < every[2]


def test_close_pairs_need_a_threshold_that_takes_signatures(spark):
    with pytest.raises(ValueError):
        similarity.close_pairs(similarity.folder_keys(files(spark, [("D:/a", "f", 1, "h")])), 0.57)


def test_zero_bytes_do_not_pair(spark):
    table = files(spark, [("D:/a/x", "f", 0, "h"), ("D:/a/y", "f", 0, "h")])
    keys = similarity.folder_keys(table)
    assert similarity.scores(similarity.candidate_pairs(keys), keys, tree.subtree_totals(table), 0.0).count() == 0


def test_unique_files_keep_null_hashes(spark):
    table = files(spark, [("D:/m", "a", 1, "h1"), ("D:/c", "a", 1, "h1"), ("D:/c", "b", 1, None), ("D:/c", "d", 1, "h2")]).withColumnRenamed("h", "full_hash")
    mastered = spark.createDataFrame([("c1", "D:/m", True), ("c1", "D:/c", False)], "cluster_id string, path string, is_master boolean")
    assert {r["path"] for r in C.unique_files(mastered, table).collect()} == {"D:/c/b", "D:/c/d"}


def test_suppression_equals_sequential(spark):
    rng = random.Random(3)
    names = ["D:/" + "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    names = sorted(set(names))
    rng.shuffle(names)
    groups = [names[i : i + 2] for i in range(0, len(names) - 1, 2)]
    groups.sort(key=lambda g: min(p.count("/") for p in g))
    active, hidden = [], set()
    for i, g in enumerate(groups):
        up = lambda p: {p.rsplit("/", k)[0] for k in range(1, p.count("/") + 1)}
        if any(all(up(p) & set(a) for p in g) for a in active):
            hidden.add(f"c{i}")
        else:
            active.append(g)
    members = spark.createDataFrame([(f"c{i}", p) for i, g in enumerate(groups) for p in g], "cluster_id string, path string")
    assert {r["cluster_id"] for r in C.suppressed(members).collect()} == hidden


def test_master_and_cycle(spark):
    members = spark.createDataFrame([("c", "E:/b"), ("c", "E:/a"), ("c", "D:/z")], "cluster_id string, path string")
    stats = spark.createDataFrame([("E:/b", 3, 10, 1, 5.0), ("E:/a", 3, 10, 1, 5.0)], "path string, file_count long, total_bytes long, depth int, mtime double")
    first = C.masters(members, stats, ["E:", "D:"])
    pick = lambda df: [r["path"] for r in df.filter("is_master").collect()]
    assert pick(first) == ["E:/a"]
    assert pick(C.next_master(first)) == ["E:/b"] and pick(C.next_master(C.next_master(first))) == ["D:/z"]


def test_funnel_reads_only_what_is_in_doubt(spark):
    table = files(spark, [("D:/a", "1", 10, "aa1"), ("D:/a", "2", 10, "aa1"), ("D:/a", "3", 10, "bb"), ("D:/a", "4", 99, "cc"), ("D:/a", "5", 1, "x"), ("D:/a", "6", 1, "x")])
    asked = []

    def look(column):
        def f(rows):
            rows = rows.join(table.select("path", "h"), "path")
            asked.append({r["path"][-1] for r in rows.collect()})
            return rows.select("path", column.alias("digest"))

        return f

    out = {r["path"][-1]: (r["quick_hash"], r["full_hash"]) for r in duplicates.funnel(table, look(F.substring("h", 1, 2)), look(F.col("h")), 5).collect()}
    assert asked == [{"1", "2", "3"}, {"1", "2"}]
    assert out == {"1": ("aa", "aa1"), "2": ("aa", "aa1"), "3": ("bb", None), "4": (None, None), "5": (None, None), "6": (None, None)}


def test_snapshots(spark, tmp_path):
    store = snapshot.SnapshotStore(spark, str(tmp_path / "t"))
    assert store.current() == 0
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")
    store.write(rows)
    store.write(snapshot.upsert(store.read(), spark.createDataFrame([("b", 3), ("c", 4)], rows.schema), "path"))
    assert {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 3), ("c", 4)} and store.read(1).count() == 2


def test_migration_and_stages(spark):
    old = spark.createDataFrame([("r", 1)], "folder_root string, n long")
    new = snapshot.with_columns(old, {"root_path": ("string", None), "is_missing": ("boolean", "false")}, {"folder_root": "root_path"})
    assert new.columns == ["root_path", "n", "is_missing"] and new.first()["is_missing"] is False
    state = spark.createDataFrame([("duplicates", 2), ("similarity", 1)], "stage string, run_id long")
    assert snapshot.stage_is_current(state, "duplicates", (), 2) and not snapshot.stage_is_current(state, "similarity", ("duplicates",), 2)


def test_stale_at_the_cutoff_is_fresh(spark):
    roots = spark.createDataFrame([("a",), ("b",), ("c",)], "root string")
    stats = spark.sql("select 'a' as root, timestamp'2024-01-01' as last_scanned_at union all select 'b', timestamp'2023-12-30'")
    got = {r["root"]: r["age_days"] for r in snapshot.stale_roots(roots, stats, F.expr("timestamp'2024-01-31'"), 30).collect()}
    assert got == {"b": 32, "c": None}


def test_large_files_of_few_and_of_many_roots(spark, monkeypatch):
    files = spark.createDataFrame([("a/b", f"a/b/{i}", i) for i in range(20)] + [("ab", "ab/x", 50), ("a", "a/y", 6), ("c", "c/z", 99)], "folder string, path string, size long")
    limits = spark.createDataFrame([("a", 15), ("a/b", 10), ("ab", 51)], "root string, threshold long")
    few = tree.large_files(files, limits)
    assert "Generate" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tree, "FEW_ROOTS", 1)
    many = tree.large_files(files, limits)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted((f"a/b/{i}", i) for i in range(10, 20))


def test_summary_of_any_number_of_roots(spark):
    stats = spark.createDataFrame([(f"r{i}", 1, 1) for i in range(12_000)] + [("r", 2, 2)], "root string, folders long, files long")
    results = spark.createDataFrame([("r1/a", "x"), ("r17", "x"), ("q", "x")], "folder_a string, folder_b string")
    matches = spark.createDataFrame([("r1/a", "x", 10**9, True), ("r17", "x", 5, False)], "folder_a string, folder_b string, size long, full_match boolean")
    got = {r["root"]: (r["similar_pairs"], r["duplicate_files"], r["duplicate_gb"]) for r in legacy.summary(stats, results, matches).collect()}
    assert len(got) == 12_001 and {k: v for k, v in got.items() if v[0]} == {"r": (2, 1, 1.0), "r1": (2, 1, 1.0), "r17": (1, 0, 0.0)}
