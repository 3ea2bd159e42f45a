import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty texts, repeated rows, ties, words of other scripts and control characters.
ODD = [
    (1, "one two three", "en", "a", 13),
    (1, "one two three", "en", "a", 13),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (None, "no id here at all", None, None, 5),
    (4, " \t\n\x0b\x0c\r ", "en", "a", 7),
    (5, "Ünïcödé ΣΊΣΥΦΟΣ İstanbul 漢字かな \U0001f600 é \x00 \x1c x y <|endoftext|> don't", "xx", "ſ", 9),
    (6, "word " * 3000, "en", "a", 15000),
    (7, " ".join(f"w{i % 97}x{i % 89}" for i in range(20000)), "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with columns whose names the operators use themselves."""
    return odd.withColumns({c: F.lit(1) for c in ("chunk", "bucket", "load", "part", "start", "ids", "key", "size", "n", "score", "shard", "rank", "count", "target")})
