import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, repeated rows, nulls, empties and columns of clashing names."""
    rng = random.Random(4)
    rows, base = [], [sentence(rng, rng.randrange(8, 120)) for _ in range(25)]
    passage = sentence(rng, 60)
    rows += base
    rows += [base[3], base[3], "  " + base[5].replace(" ", "\n")]
    for text in base[:6]:
        w = text.split()
        w[len(w) // 2] = "changed"
        rows.append(" ".join(w))
    rows += [sentence(rng, 30) + " " + passage + "\n" + sentence(rng, 20) for _ in range(5)]
    rows += [None, "", " \n", "one", "same same same same same same same same same same same same", "a b c d e " * 30, sentence(rng, 9000), "<|endoftext|> x  y é z "]
    data = [(i, t, "en", f"src{i % 3}", len(t or ""), 1, "x", 2.0) for i, t in enumerate(rows)] + [(0, rows[0], "en", "src0", 5, 1, "x", 2.0), (None, "null id text of some words here", "en", None, None, 1, "x", 2.0)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n_words int, quality string, score double").repartition(3)


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.where("1 = 0")
