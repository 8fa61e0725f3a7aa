import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = "an er in on re th he st nd ou ea ti es or ha at en of sh ing ble tion".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Writes tables to a folder as the queries read them."""

    def to(**tables):
        d = tmp_path_factory.mktemp("sf")
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{d}/{name}.parquet")
        return str(d)

    return to


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, ties, repeated rows, a long text, null ids, languages and sources."""
    rng = random.Random(3)
    long = prose(rng, 20_000)
    base = prose(rng, 120)
    return [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base, "en", None, 2),
        (3, None, None, "a", None),
        (4, "", "en", "b", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, "one", "en", "b", 3),
        (7, long, "en", "c", len(long)),
        (8, long + " tail", "en", "c", 1),
        (9, "x" * 50_000, "de", "c", 1),
        (None, base, "en", "a", 5),
        (None, "no id", None, None, 5),
        (10, "the the " * 300, "en", "a", 1),
        (11, "1234 5678 !!", "en", "a", 1),
        (12, "ein über größe \U0001f600 еnd", "de", "a", 1),
    ]
