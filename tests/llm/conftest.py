import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use inside
    "row long, k1 long, h string, bucket long, shard int, src int, band long, score double, label int, taken long, kept string, path string"
)
CLASH = (1, 2, "h", 3, 4, 5, 6, 7.0, 8, 9, "kept", "path")


def rows_of(pairs):
    """Rows (doc_id, text, source) with the other columns filled."""
    return [(i, t, "en", s, len(t or ""), *CLASH) for i, t, s in pairs]


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


EDGE = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one two", "b"), (5, "One  TWO", "b"), (6, "one two three four five", "a"),
    (7, "ONE two three four five", "c"), (7, "ONE two three four five", "c"), (8, "é ß İ  x y z", None), (9, "a\n\na\n", "a"),
    (10, "x" * 70, "a"), (11, "y" + "x" * 70, "a"), (12, " ".join(words(30_000, 1)), "b"), (13, " ".join(words(30_000, 1)) + " end", "b"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(EDGE), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
