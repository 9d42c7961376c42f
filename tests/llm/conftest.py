import pytest

#: Nulls, empty texts, ties, repeated rows and clashing extra columns, for every operator on documents.
ODD = [
    (None, "no id but some words here and there in a row", "s"), (1, None, "s"), (2, "", None), (3, "   \n\t ", "s"), (4, "one two", "t"), (4, "one two", "t"),
    (5, "word " * 3000, "s"), (6, "ünïcödé   text\nwith\tblanks", "t"), (7, "one two", "t"), (8, "x" * 5000, None),
]


@pytest.fixture
def odd(spark):
    """(doc_id, text, source, and columns named like results)."""
    schema = "doc_id long, text string, source string, score string, size string, key string, node string, copy string, kept string"
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in ODD], schema)


@pytest.fixture
def empty(odd):
    return odd.where("false")
