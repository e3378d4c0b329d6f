from __future__ import annotations

import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, grp string, carry long, "
          "ids string, sig long, digest string, node double, rng string, guest long, score string, label string, cls long")
CLASHING = ["x", 1, "y", 2, "z", 0.5, "r", 3, "s", "l", 4]


@pytest.fixture(scope="session")
def words_pool():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) as a table with the columns of documents, others
    whose names an operator might use itself, and in several partitions."""
    def build(rows):
        full = [[r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
                 None if r[1] is None else len(r[1]), *CLASHING] for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)
    return build


@pytest.fixture(scope="session")
def edge_rows(words_pool):
    """Nulls, empty and very long texts, repeated rows, equal ids, other scripts."""
    rng = random.Random(9)
    story = " ".join(rng.choices(words_pool, k=60))
    long = " ".join(rng.choices(words_pool, k=60_000))
    return [
        (1, story, "en", "a"), (2, None, "en", "a"), (3, "", "fr", None), (4, " \t\n ", None, "b"),
        (5, story, "en", "b"), (6, f"intro words here {story} and an end", None, None), (7, long, "en", "a"),
        (8, long + " tail", "en", "a"), (9, "one", "de", "b"), (9, "one", "de", "b"), (10, story, "en", "a"),
        (None, story, "en", "a"), (None, None, None, None), (11, "日本語 のテキスト 🙂 été", "fr", "a"),
        (12, "1234 5678 !!! ---", "es", "b"), (13, "a" * 5000, None, "a"), (-4, story.upper(), "en", "c"),
    ]
