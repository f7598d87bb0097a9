"""Small tables for the training-data operators. The session comes from the tests above."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Make a documents table of (id, text) or (id, text, lang) rows."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture()
def prose():
    """A maker of invented prose: prose(seed, number of words)."""

    def make(seed, n, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join("".join(chr(97 + int(c)) for c in str(rng.randrange(vocabulary))) + "x" for _ in range(n))

    return make
