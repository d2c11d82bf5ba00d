import pytest
from pyspark.sql import functions as F

from stratafold.functions import hashing, paths, scoring, sizes


def column(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(make(F.col("v"))).collect()]


def test_normalise(spark):
    assert column(spark, ["C:\\a\\b\\", "/x//y/", "/", " a ", None], paths.normalise) == ["C:/a/b", "/x/y", "/", "a", None]


def test_parts(spark):
    assert column(spark, ["a/b/c", "a", None], paths.parent) == ["a/b", None, None]
    assert column(spark, ["x.tar.gz", ".bashrc", "A.TXT", "n"], paths.suffix) == [".gz", "", ".txt", ""]
    assert column(spark, ["a/b/c"], lambda c: paths.ancestors(c)) == [["a", "a/b", "a/b/c"]]
    assert column(spark, ["a"], lambda c: paths.ancestors(c, 1, itself=False)) == [[]]
    assert column(spark, ["/data", "/data/x", "/data2", "/DATA/x"], lambda c: paths.under(c, F.lit("/data"))) == [True, True, False, False]
    assert column(spark, ["c/x/y", "d/z"], lambda c: paths.relative(c, F.lit("c"))) == ["x/y", "z"]


@pytest.mark.parametrize("text, size", [(0, 0), (1024, 1024), ("500", 500), ("500B", 500), ("1 KB", 1024), ("500mb", 500 << 20), ("2GB", 2 << 30), ("1.5GB", 3 << 29)])
def test_parse_size(text, size):
    assert sizes.parse_size(text) == size


@pytest.mark.parametrize("text, days", [(30, 30), ("30d", 30), ("2w", 14), ("1m", 30), ("2 months", 60), ("3 days", 3), ("1.5w", 10)])
def test_parse_days(text, days):
    assert sizes.parse_days(text) == days


@pytest.mark.parametrize("bad", ["", "x", "1XB", "-1", "1.2.3MB"])
def test_bad_sizes(bad):
    with pytest.raises(ValueError):
        sizes.parse_size(bad)


def test_size_columns(spark):
    assert column(spark, ["1 KB", "x", None, "2.5mb"], sizes.size_of) == [1024, None, None, 2621440]
    assert column(spark, [1280 << 20, 1 << 20, 512], sizes.human, "long") == ["1.2 GB", "1.0 MB", "0.5 KB"]


def test_scores(spark):
    row = spark.range(1).select(
        scoring.ratio(F.lit(0), F.lit(0)).alias("r"), scoring.jaccard(F.lit(0), F.lit(0), F.lit(0)).alias("j"),
        scoring.score(F.lit(1.0), F.lit(1.0), F.lit(0.2)).alias("s"), scoring.name_bonus(F.lit("golden"), F.lit("x")).alias("b"),
    ).first()
    assert (row["r"], row["j"], row["b"]) == (0.0, 0.0, 0.2) and row["s"] == pytest.approx(0.92)


def test_hashes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 10)
    (tmp_path / "b").write_bytes(b"h" * 4096 + b"1" * 4096 + b"t" * 4096)
    (tmp_path / "c").write_bytes(b"h" * 4096 + b"2" * 4096 + b"t" * 4096)
    asked = spark.createDataFrame([(str(tmp_path / n),) for n in "abcz"], "path string")
    quick = {r["path"][-1]: r for r in hashing.hash_files(asked, "quick").collect()}
    full = {r["path"][-1]: r for r in hashing.hash_files(asked, "full").collect()}
    assert quick["b"]["digest"] == quick["c"]["digest"] != quick["a"]["digest"]
    assert full["b"]["digest"] != full["c"]["digest"]
    assert quick["z"]["digest"] is None and quick["z"]["error"]


def test_fixed_rounds_like_python(spark):
    values = [0.825, 0.835, 0.875, 0.125, 0.375, 1.25, 1.35, 0.0, 0.005, 0.015, 0.995, 2.675, 123456.785] + [i / 997 for i in range(1, 200)] + [i / 1000 for i in range(200)]
    for digits in (1, 2):
        assert column(spark, values, lambda c: sizes.fixed(c, digits), "double") == [f"{v:.{digits}f}" for v in values]
