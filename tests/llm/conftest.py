import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, row string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, None, None, None),
        (None, "a text without an id, of some words", "en", "s", 1, 0.5, 3, "x"),
        (2, "", "en", "s", 0, 0.1, 1, "x"),
        (3, " \n\t ", "fr", None, 3, None, 1, None),
        (4, "12 345 %% --", "de", "s", 3, 1.0, 2, "y"),
        (5, "one two three four five six seven eight nine ten", "en", "s", 9, 1.0, 2, "y"),
        (5, "one two three four five six seven eight nine ten", "en", "s", 9, 1.0, 2, "y"),
        (6, "One two three four five six seven eight nine TEN", "en", "t", 9, None, 2, "y"),
        (7, long, "en", "s", len(long), 1.0, 2, "y"),
        (8, "deux mots", None, "s", 2, 1.0, 2, "y"),
        (9, "été naïve — “quoted” 漢字 \U0001f600 <|endoftext|>", "fr", "s", 2, 1.0, 2, "y"),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def small():
    """A small real table and the folder it is in."""
    return "/root/testdata/sf0.001"
