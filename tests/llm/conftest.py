import random
import re

import pytest

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Few words, so that much repeats; copies, edits, nulls, empty and blank texts, repeated lines."""
    r = random.Random(seed)
    vocabulary = [w for w in "the of and to in that it is was for on are with as his they at be this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way".split()]
    texts: list = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(n)]
    texts += [texts[0], texts[1], texts[1] + " more of it", "\n".join(texts[2:5]), texts[3] + "\n" + texts[4] + "\nend", None, "", " \n\t ", "é" * 300, "ab" * 200, "ab" * 190, "Aa " * 200]
    texts += [" ".join(t.split()[:25] + ["edited"] + t.split()[26:]) for t in texts[:10] if t and len(t.split()) > 40]
    r.shuffle(texts)
    return [(i * 3 % 1009, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated and null ids, and columns whose names the operators use themselves."""
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t, 5, 6, 7, "x"), (1, t, 5, 6, 7, "x"), (1, t + " z", 5, 6, 7, "x"), (None, t, 5, 6, 7, None), (2, None, 5, 6, 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, row long, spans int, size int, source string")
