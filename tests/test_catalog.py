import pytest
from compare import SF, duck_rows, spark_rows

from stratafold import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert spark_rows(catalog.queries()[name](spark, SF)) == duck_rows(catalog.oracle_sql()[name])


def test_review_counts_has_no_cap(spark, tmp_path):
    """One file in the folders of 60 sources: every key is held by more folders than the cap of the other queries."""
    rows = [(1, "the same text", "en", f"src{i}", 13) for i in range(60)] + [(2, "another", lang, "src70", 7) for lang in ("en", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    keys = catalog._keys(spark, str(tmp_path)).filter("key like 'doc_1.en|%'")
    assert keys.count() > catalog.CAP
    found = spark_rows(catalog.queries()["review_counts"](spark, str(tmp_path)))
    assert found == duck_rows(catalog.oracle_sql()["review_counts"], str(tmp_path))
    assert found[1] == [("1", "approved"), ("2", "pending")]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
