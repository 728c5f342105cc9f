import random

import pytest

#: Names that the operators use inside.
CLASHING = {"size": 1, "band": "b", "component": 2, "rep": 3, "start": 4, "name": "n", "group": 5, "_group": 6, "target": 7.0, "_h": 8, "_id": 9, "_position": 1.5, "_pass": 10}


def corpus(seed=3, n=120):
    """Texts with exact and near copies, shared passages, repeats inside a text, short, empty and null ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["the"] * 60 + ["Of"] * 30

    def some(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage, texts = some(60), []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.35:
            w = (rng.choice(texts) or "x").split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        elif kind < 0.5:
            cut = rng.randint(0, 30)
            texts.append(" ".join(some(rng.randint(0, 40)) + passage[cut:cut + rng.randint(15, 30)] + some(rng.randint(0, 40))))
        elif kind < 0.6:
            texts.append("\n".join([" ".join(some(9) * rng.randint(1, 6)), " ".join(some(5) + ["same"] * rng.randint(1, 50))]))
        elif kind < 0.68:
            texts.append(rng.choice([None, "", " \n\t ", "one", "two words", "One  two\tthree\x0bfour"]))
        else:
            texts.append(rng.choice([" ", "\n", "  "]).join(some(rng.randint(1, 200))))
    texts.append(" ".join(some(4_000)))
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, f"s{d % 3}") for d, t in rows], "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, equal ids, repeated rows, extra columns with names used inside."""
    values = list(CLASHING.values())
    rows = [(None, None, None), (None, "a b c d e f g", "x"), (5, "same id", None), (5, "another text with this id", "x"),
            (7, "twice the same row " * 12, "x"), (7, "twice the same row " * 12, "x"), (9, "", None), (11, " \n", "y"),
            (-3, "ÄÖ ü — 漢字 𝒳 a b\x1cc", "y")]
    df = spark.createDataFrame([(*r, *values) for r in rows], "doc_id long, text string, source string, " + ", ".join(
        f"`{k}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in CLASHING.items()))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
