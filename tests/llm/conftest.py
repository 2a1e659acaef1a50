import random

import pytest

WORDS = [a + b for a in "ba de fo gi hu ka le mi no pu".split() for b in "ran tis lom ver nak".split()]


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and names that operators use inside."""
    rows = [
        (1, prose(1, 120), "en", "a", 1, "x"),
        (1, prose(1, 120), "en", "a", 1, "x"),
        (2, prose(1, 120).upper(), "en", "a", 2, "x"),
        (3, None, "en", "b", 3, None),
        (4, "", None, None, 4, "y"),
        (5, " \n\t ", "de", "b", None, "y"),
        (None, prose(2, 60), "de", None, 6, "y"),
        (None, None, None, None, None, None),
        (6, prose(3, 3), "en", "a", 7, "z"),
        (7, prose(4, 30_000), "en", "c", 8, "z"),
        (8, "*** ### $$$", "en", "c", 9, "z"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _id int, _row string").withColumnsRenamed({})


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
