import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, spans string, its_id string, node int, copies string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text, source), with columns whose names clash with those of results."""

    def make(rows):
        full = [(d, t, "en", s, len(t or ""), "x", "y", "z", "w", 1, "v") for d, t, s in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


def words(n, seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long = words(30_000, 1)
    return [
        (1, words(50, 2), "a"),
        (1, words(50, 2), "a"),
        (2, words(50, 2), "b"),
        (3, None, "a"),
        (4, "", None),
        (5, long, "c"),
        (6, long + " more", None),
        (None, "null id", "a"),
        (7, "ünïcödé ß 日本語 text under the MIT License.", "b"),
        (8, "!!! ###", "b"),
    ]
