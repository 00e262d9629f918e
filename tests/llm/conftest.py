import random

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """Documents from (doc_id, text, source) with columns whose names clash with those operators use."""

    def make(rows, clash=True):
        df = spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], DOCUMENT)
        if clash:
            for name in ("size", "score", "target", "pieces", "key", "label", "n", "shard", "slot", "node", "root", "n_lines", "place", "_row"):
                df = df.selectExpr("*", f"'{name}' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def words():
    """Invented words, the same in every run."""
    rng = random.Random(5)
    return ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8))) for _ in range(600)]


@pytest.fixture
def odd(words):
    """Nulls, empty and blank texts, ties, repeated rows, other scripts and a very long text."""
    rng = random.Random(9)
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "one two three four five six seven", "b"), (None, "another text without an id and some words", None),
        (4, "same words in this text are here twice", "a"), (5, "same words in this text are here twice", "b"), (5, "same words in this text are here twice", "b"),
        (6, "日本語 の テキスト \U0001f600 é", "ä"), (7, "x", ""), (-8, long, "c"), (9, "Line one of a text that goes on for a while\nline two\n\n", "c"),
    ]
