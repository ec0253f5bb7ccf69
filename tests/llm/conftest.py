import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ord long, row string"
WORDS = {"en": "the of and to in that it is was for on with as his they be at one have this from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}


def prose(rng, lang, n):
    words = [rng.choice(WORDS[lang]) if rng.random() < 0.4 else "".join(rng.choice(["ba", "ke", "lo", "mi", "tu", "sch", "th", "er"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if not i % 9 else w for i, w in enumerate(words))


def corpus():
    """Small documents with copies, near copies, a shared passage, nulls, empty and odd texts, a repeated row."""
    rng = random.Random(5)
    texts = [prose(rng, "en" if i % 2 else "de", rng.randint(3, 160)) for i in range(36)]
    passage = prose(rng, "en", 70)
    texts += [texts[3], texts[3], texts[30] + " extra", prose(rng, "en", 30) + " " + passage, passage + " " + prose(rng, "de", 20), None, "", "   \n", "1234 !!", "é" * 300, "no spaces", "x" * 250 + "y" * 250 + "x" * 250]
    rows = [(i * 3, t, "de" if i < 36 and not i % 2 else "en", f"s{i % 4}", len(t or ""), 7, "r") for i, t in enumerate(texts)]
    return rows


def awkward():
    """The corpus with a repeated row, equal ids of different texts, and null ids."""
    rows = corpus()
    return [*rows, rows[5], (rows[6][0], "the same id of another text " * 12, None, None, None, 7, "r"), (None, rows[2][1], "en", "s", 1, 7, "r"), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
