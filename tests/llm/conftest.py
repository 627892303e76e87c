import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns."""
    rows = [
        (1, "One line of plain words that is long enough to count as one.\nAnd more.", "en", "a", 71),
        (1, "One line of plain words that is long enough to count as one.\nAnd more.", "en", "a", 71),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, "   \n\t ", "en", "a", 6),
        (5, "12345 !!! ???", "fr", None, 13),
        (6, "le la des une pour que les enfants " * 9000, "fr", "b", 315000),
        (7, "x" * 4000, None, "b", 4000),
        (8, "das ist ein Haus und die Straße ist lang", "de", "c", 40),
        (None, "no id but words in the text of this row", "en", "c", 39),
        (9, "el perro y la casa son de los niños 漢字 🙂", "es", "c", 41),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_tokens", "'x' AS score", "2 AS SHARD", "3 AS id", "4 AS fingerprint", "5 AS contaminated")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
