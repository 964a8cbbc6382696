import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, n long, row_id long, x double, score double, gone_id long"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def frame(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, 2, 3, 0.5, 0.5, 4) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, a long one, repeated rows, ties."""
    rng = random.Random(3)
    long = words(rng, 30_000, 5000)
    rows = [(0, None, None), (1, "", "a"), (2, " \t\n ", "a"), (3, "one", "b"), (4, "one", "b"), (5, long, "a"), (6, words(rng, 120), None), (6, words(random.Random(9), 120), "b"), (7, "É ÀB \x0b\x0c word\nword", "ß"), (8, "a\nb\na\n", "b")]
    return frame(spark, rows + rows[3:5])


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
