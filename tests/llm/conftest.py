"""Small documents with every odd case: nulls, empty texts, ties, repeated rows, columns whose names clash."""

import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node bigint, component bigint, doc string, kept string"


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho tau".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    out = []
    for k in range(60):
        out.append(words(rng, rng.choice([3, 20, 60, 120])))
    for k in range(40):  # near copies, each a step further from the first
        base = out[k % 5 + 10].split()
        for _ in range(k % 7):
            base[rng.randrange(len(base))] = f"edit{rng.randrange(1000)}"
        out.append(" ".join(base))
    out += [out[2], out[2], "", None, "   \n\t ", "one", "One", "two words", "TWO  words", "Été \U0001f600 café", words(rng, 20000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 4}", None, 1, 1, "x", "y") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], None, None, None, 1, 1, "x", "y"), (None, None, None, None, None, 1, 1, "x", "y")]
    return spark.createDataFrame(rows, DOCS).repartition(3)
