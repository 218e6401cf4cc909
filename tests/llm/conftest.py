import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, hi long, component string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns whose names the operators use themselves."""
    words = [f"wort{i}" for i in range(400)]
    rng = random.Random(5)
    base = " ".join(rng.choices(words, k=60))
    near = base.replace(base.split()[30], "anders", 1)
    long = " ".join(rng.choices(words, k=20_000))
    texts = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, "   "), (7, "x"), (8, long), (9, "a" * 30_000), (10, "!!! ??? ..."), (11, "eins zwei drei"), (11, "eins zwei drei"), (None, base), (None, None), (12, "𝔘nicode ß É é ﬁ \u00a0 İ"), (13, " ".join(rng.choices(words, k=50)))]
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), 7.5, 1, 2, "c") for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (13, 1, 0), (13, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
