import pytest
from pyspark.sql import Row

LONG = "alpha beta gamma delta " * 9000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash with inner ones."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n", None, None), (4, LONG, "en", None), (5, LONG, "de", "b"), (5, LONG, "de", "b"), (6, "x", "en", "b"), (7, "one two three four five six seven", "en", "a"),
        (8, "one two three four five six seven", "en", "a"), (None, "one two three four five six seven", "en", "a"), (9, "é" * 500, "fr", "a"), (10, "a\x00b \U0001f600 ▁▁ x", "fr", "c"), (None, None, None, None),
    ]
    made = [Row(doc_id=i, text=t, lang=g, source=s, k=n, t=f"t{n}", _row=n, size=str(n), _gone=n, id=n) for n, (i, t, g, s) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, k int, t string, _row int, size string, _gone int, id int"
    return spark.createDataFrame(made, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
