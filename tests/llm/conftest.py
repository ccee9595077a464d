import random

import pytest

WORDS = [a + b for a in ("th", "er", "on", "an", "re", "he", "in", "ed") for b in ("tion", "and", "es", "of", "ing", "ou", "le")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `text_hash` long, fp string, row string, hits string, start int, words string, ids string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n))


def make_docs(spark, texts, ids=None, lang="en"):
    """Documents with columns whose names clash with those that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, "s", None if t is None else len(t), 1, "x", "y", "z", 3, "w", "i") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, marks only, repeated rows, other scripts, a very long text."""
    return [None, "", " \n\t ", "word", "?!... --", "one two", "one two", prose(1, 30), prose(1, 30), "Größe naïve ÉTÉ 日本語 текст é", "a" * 5000, prose(2, 30000), None]
