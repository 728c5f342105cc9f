import random
from collections import Counter

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from flowlens.llm.outliers import COUNTS, FLOORS, STEADY, P, estimate, quality_rules, statistics


def plain_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


VOCABULARY = {x: [f"{x}{''.join(random.Random(f'{x}{i}').choices('abcdefgh', k=2 + i % 6))}" for i in range(2_000)] for x in ("x", "yy")}


def prose(rng, language, n):
    own = VOCABULARY[language]
    return "\n".join(" ".join([rng.choice(own).capitalize(), *[rng.choice(own) for _ in range(12)]]) for _ in range(n // 12))


@pytest.fixture(scope="module")
def planted():
    """Clean texts of two languages and sources, and outliers of several kinds: (doc_id, text, lang, source), outliers' ids."""
    rng, rows, bad = random.Random(7), [], set()
    for d in range(900):
        lang, source = rng.choice(["x", "yy"]), rng.choice(["s", "t", None])
        text = prose(rng, lang, rng.randint(60, 500))
        if rng.random() < 0.12:
            bad.add(d)
            text = [lambda t: t.replace(" ", "&&& "), lambda t: t.upper(), lambda t: " ".join(x for w in t.split() for x in [w] * 6),
                    lambda t: t.replace(" ", " | ")][d % 4](text)
        rows.append((d, text, lang, source))
    return rows, bad


SCHEMA = "doc_id long, text string, lang string, source string"


def test_counts_against_plain_version(spark, docs, rows):
    got = {r.doc_id: r for r in quality_rules(docs.withColumn("lang", F.lit("en"))).collect()}
    for d, t in rows:
        want = plain_counts(t)
        assert tuple(got[d][c] for c in COUNTS) == want
        assert got[d].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_outliers_go_and_clean_texts_stay(spark, planted):
    rows, bad = planted
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(got) == len(rows)
    gone = {d for d in got if not got[d].kept}
    assert bad <= gone and len(gone - bad) <= 0.005 * (len(rows) - len(bad))


def test_distances_agree_with_an_exact_search_for_the_subset(spark, planted):
    """The least determinant over many random starts with whole sorts, on one group."""
    rows, bad = planted
    texts = [t for _, t, lang, _ in rows if lang == "x"]
    got = quality_rules(spark.createDataFrame([(i, t, "x", "s") for i, t in enumerate(texts)], SCHEMA)).orderBy("doc_id").collect()
    import pyarrow as pa
    counts, vectors = (np.concatenate(x) for x in list(zip(*statistics(pa.array(texts)), strict=True))[1:])
    use = ~np.array([r.base_failed for r in got])
    counts, vectors = counts[use], vectors[use]
    centre = np.median(vectors, axis=0)
    spread = np.maximum(FLOORS, 1.4826 * np.median(np.abs(vectors - centre), axis=0))
    y = np.sqrt(counts[:, :1] / (counts[:, :1] + STEADY)) * (vectors - centre) / spread
    pairs, rng, best = np.triu_indices(P), np.random.default_rng(0), None

    def from_rows(part, share):
        second = part.T @ part
        return estimate(np.concatenate([[len(part)], part.sum(axis=0), second[pairs]]), share)

    def away(mean, inverse):
        z = y - mean
        return np.einsum("ij,jk,ik->i", z, inverse.reshape(P, P), z)

    for _ in range(40):
        d2 = away(*from_rows(y[rng.choice(len(y), P + 2, replace=False)], 0.75)[:2])
        for _ in range(25):
            mean, inverse, logdet = from_rows(y[np.argsort(d2)[:int(np.ceil(0.75 * len(y)))]], 0.75)
            d2 = away(mean, inverse)
        if best is None or logdet < best[0]:
            best = (logdet, d2)
    inside = best[1] <= 14.45  # 97.5 % of chi square with 6 degrees of freedom
    exact = np.sqrt(away(*from_rows(y[inside], 0.975)[:2]))
    found = np.array([r.distance for r, u in zip(got, use, strict=True) if u])
    assert np.corrcoef(np.argsort(np.argsort(exact)), np.argsort(np.argsort(found)))[0, 1] > 0.98
    assert np.median(np.abs(exact - found) / np.maximum(exact, 0.5)) < 0.15


def test_layout_does_not_matter(spark, planted):
    rows, _ = planted
    df = spark.createDataFrame(rows[:300], SCHEMA)
    a, b = ({r.doc_id: (r.kept, None if r.distance is None else round(r.distance, 6)) for r in quality_rules(x).collect()} for x in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_odd_rows(spark, odd, nothing):
    got = quality_rules(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(got) == 9
    assert all(r.base_failed != r.kept and r.distance is None for r in got)  # too few texts for an estimate
    assert {r.n_words for r in got if r.doc_id == 7} == {48} and [r.n_words for r in got if r.doc_id == 9] == [0]
    assert quality_rules(nothing.withColumn("lang", F.lit("x"))).count() == 0


def test_very_long_text_and_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(1, prose(rng, "x", 200), "x", "s")] * 150 + [(2, prose(rng, "x", 60_000), "x", "s")] + [(3 + k, prose(rng, "x", 200), "x", "s") for k in range(150)]
    got = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.kept for r in got if r.doc_id > 2)
    assert len({(r.kept, r.distance) for r in got if r.doc_id == 1}) == 1
    assert plain_counts(rows[150][1]) == next(tuple(r[c] for c in COUNTS) for r in got if r.doc_id == 2)
