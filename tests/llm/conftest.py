import pytest
from hypothesis import settings

# The first example of a test loads vocabularies, for longer than hypothesis allows an example by default.
settings.register_profile("vocabularies", deadline=None)
settings.load_profile("vocabularies")

LONG = "una palabra larga y otra, the end of it. " * 60_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again.", 7),
    (2, None, 7),
    (3, "", None),
    (4, " \t\n ", 7),
    (5, LONG, 7),
    (6, "The quick brown fox jumps over the lazy dog, again and again.", 7),
    (6, "The quick brown fox jumps over the lazy dog, again and again.", 7),
    (None, "no id at all", 7),
    (8, "é 日本 <|endoftext|> İ it's 12 a\x1cb", 7),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens int")
    return rows.select("*", *[F.lit("x").alias(c) for c in ("id", "key", "score", "lang", "source", "node", "words", "start", "label")])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
