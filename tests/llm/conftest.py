import random

import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long, sketch string, spans int"


@pytest.fixture(scope="session")
def prose():
    def make(seed, n, size=400):
        r = random.Random(seed)
        words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(size)]
        return [r.choice(words) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents with columns whose names operators use themselves."""

    def make(rows, lang="en", source="s"):
        return spark.createDataFrame([(d, t, lang, source, len(t or ""), "x", 1) for d, t in rows], TEXT)

    return make
