import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, h long, rep long, skey string, spans string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "   \n\t ", "en", "s1", 6), (4, "one two three", "en", "s1", 13), (5, "One TWO  three", "en", None, 14),
        (6, long, "en", "s2", len(long)), (7, long, "en", "s2", len(long)), (8, "Released under the MIT License. The GNU General Public License", "de", "s3", 60),
        (8, "Released under the MIT License. The GNU General Public License", "de", "s3", 60), (9, "é ñ 日本語 \U0001f600 " * 30, "fr", "s3", 300), (None, "null id text", "en", "s1", 12),
        (10, "12345 --- !!!", None, "s1", 13), (11, "line\r\nline line\x00end", "es", "s4", 20),
    ]
    return spark.createDataFrame([(*r, "clash", 7, 8, "n", "c") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
