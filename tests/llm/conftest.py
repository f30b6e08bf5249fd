import os
import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n long, value string, places string, id long, digest string, bits string"


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from (id, text) or (id, text, source), with extra columns whose names clash with those operators use."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None, 7, "v", "p", 9, "d", "b") for r in rows]
        return spark.createDataFrame(full, COLUMNS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, repeats within a text, and odd ones."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeghé") for _ in range(rnd.randint(1, 5)))
    texts = [[word() for _ in range(rnd.choice([0, 1, 2, 3, 20, 60, 200]))] for _ in range(60)]
    passage = [word() for _ in range(50)]
    for t in texts[:12]:
        at = rnd.randint(0, len(t))
        t[at:at] = passage
    texts += [list(t) for t in texts[:9]] + [list(texts[20])] * 4
    for t in texts[25:40]:
        copy = list(t)
        if copy:
            copy[rnd.randrange(len(copy))] = "changed"
        texts.append(copy)
    texts.append(["again"] * 90)
    texts.append(["x" * 300] * 3 + passage * 2)
    joined = ["".join(w + rnd.choice([" ", "\n", "  ", "\t"]) for w in t) for t in texts]
    return list(enumerate([*joined, None, "", " \n ", "ONE Two three", "one two THREE", "x" * 20000, " ".join(passage * 40)]))
