import pytest

SF = "/root/testdata/sf0.001"
LONG = ("alpha beta gamma delta " * 9000).strip()
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.\nThe end, my friend."),
    (2, "The quick brown fox jumps over the lazy dog again and again.\nThe end, my friend."),
    (2, "The quick brown fox jumps over the lazy dog again and again.\nThe end, my friend."),
    (3, None), (4, ""), (5, " \n\t "), (None, "no id here, just words in a row"), (None, None), (6, LONG), (7, "日本語 😀 naïve café"), (8, "one"), (9, "one two"), (10, "x" * 3000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, blanks, repeats, a long text, and columns with clashing names."""
    rows = [(i, t, "en" if k % 2 else None, "s" if k % 3 else None, None, "clash", 1.0, 0, b"x") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, m double, fp long, body binary")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
