import pytest

LONG = "lorem ipsum " * 20_000


def table(spark, rows, extra=True):
    """documents with columns that clash with the operators' own names."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        kind += ", id long, fp string, key string, place string, size string, h string, label string, n string, root string, text2 string"
        rows = [(*r, 1, "x", None, "p", "s", "h", "l", "n", "r", None) for r in rows]
    return spark.createDataFrame(rows, kind)


MESSY = [
    (1, "one two three four five six seven eight", "en", "a", 1), (2, "one two three four five six seven eight", "en", "b", 1),
    (2, "one two three four five six seven eight", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "", 0), (5, " \t\n ", None, "a", 3),
    (6, LONG, "en", None, 9), (None, "one two three four five six seven eight", "en", "a", 1), (None, None, None, None, None),
    (7, "été à la plage İ \U0001f600 42", "fr", "é", 5), (8, "12 34 !!", "de", "b", 8), (9, LONG, "en", "a", 9),
]


@pytest.fixture
def messy(spark):
    return table(spark, MESSY)


@pytest.fixture
def empty(spark):
    return table(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: table(spark, rows, extra=False)


SF = "/root/testdata/sf0.001"
