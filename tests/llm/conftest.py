import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table and clashing names."""
    def build(rows):
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOC_SCHEMA)

    return build


@pytest.fixture(scope="session")
def plain_rows(folder):
    import duckdb

    return duckdb.connect().sql(f"select doc_id, text from '{folder}/documents.parquet' order by 1").fetchall()


ODD_ROWS = [
    (None, "a row without id and some words of its own"), (1, None), (2, ""), (3, "   \n\t "), (4, "One"),
    (5, "word " * 30_000), (6, "one two"), (7, "one two"), (7, "one two"), (8, "é漢字😀  \x85 naïve ½"),
    (9, "x" * 120_000), (10, "\x00 control \x1c\x1f bytes"),
]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, letters of many kinds."""
    return ODD_ROWS
