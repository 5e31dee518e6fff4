import random

import pytest

WORDS = [a + b for a in ("re", "th", "on", "an", "er", "st", "in") for b in ("ing", "tion", "at", "es", "ly", "ou")]


def prose(seed, n=120):
    rng = random.Random(seed)
    out, line = [], []
    for _ in range(n):
        line.append(rng.choice(WORDS) + rng.choice(WORDS))
        if rng.random() < 0.1:
            out.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*out, " ".join(line)])


#: Texts that every operator must take: null, empty, blank, short, very long, unbroken, repeated rows, other scripts.
def awkward():
    long = "\n".join(prose(k, 300) for k in range(120))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "Word."), (5, long), (6, "x" * 70_000), (7, prose(7)), (7, prose(7)), (8, prose(7)), (9, "猫が座る。\u00a0Ünïcode 😀 " * 30), (None, prose(9)), (10, "a  b\x0bc\rd   e ")]


@pytest.fixture(scope="session")
def odd(spark):
    """The awkward texts with extra columns whose names clash with operators' own."""
    rows = [(k, t, "en", f"src{(k or 0) % 3}", None if t is None else len(t), 1.0, 2, "h", True, 5) for k, t in awkward()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, piece int, row string, kept boolean, fp long").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def text_of():
    return prose
