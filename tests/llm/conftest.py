import os
import random
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests"), os.path.join(ROOT, "tests", "llm")]

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it for was on are as with by he she we river stone cloud paper green light seven forest window garden".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def documents():
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(30, 120)) for _ in range(25)]
    passage = sentence(rng, 45)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text, "en", f"s{n % 3}", len(text or "")))
        n += 1

    for t in base:
        add(t)
        if rng.random() < 0.5:
            add(t.replace(" ", "  \n", 2))
        if rng.random() < 0.6:
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            add(" ".join(w))
        if rng.random() < 0.4:
            add(sentence(rng, 10) + " " + passage + " " + sentence(rng, 12))
    for t in (None, "", " ", "\n\t ", "one", "one", "One", "one two three four", "one two three four five", "sh " * 60, "sh " * 70, passage, passage.upper()):
        add(t)
    add(" ".join(sentence(rng, 6000) for _ in range(2)))
    for _ in range(40):
        add(base[0])
    return rows


@pytest.fixture(scope="session")
def odd(documents):
    """The documents with null ids, repeated ids and repeated rows."""
    return documents + documents[:5] + [(None, "null id text one", None, None, None), (None, None, None, None, None), (3, "other text of id three", "en", "s0", 1), (None, "null id text one", None, None, None)]
