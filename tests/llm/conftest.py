import random

import pytest

WORDS = "the of and to in is that for it as was on be with by are this from at or an have not we can all has".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source, n_chars, and columns named like the operators' own."""
    rng = random.Random(5)
    texts = [None, "", "   \n\t ", "one two three", "x" * 30_000, prose(rng, 3000), "é" * 700 + " ß 😀 日本", "a\x00b \x0b c\r\n d", "ﬁne don't +1 (262) 555-7240 a.b@c.de 1.2.3.4"]
    base = [prose(rng, 120) for _ in range(6)]
    texts += base + base[:3] * 2 + [b.replace(" the ", " a ", 1) for b in base] + [b + " tail end" for b in base]
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base[0], "en", "s0", 1), (3, "one two three", "en", "s1", 13)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, 1, "k", 2.0) for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long, rep int, key string, length double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
