import random
import zlib

import numpy as np

from flowlens.llm.pu_learning import _sample, cross_validate, estimate_prior, fit_nnpu
from flowlens.llm.quality import good_documents, quality_scores
from flowlens.llm.toxicity import toxicity_scores


def planted(spark, n=1500, seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "rotten", "foul"])
        if junk:
            w = [x.upper() + "!!" if rng.random() < 0.7 else x for x in w]
        docs.append((d, " ".join(w), "en"))
        if d % 2:
            labels.append((d, int(not junk), int(toxic)))
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(4),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels})


def accuracy(rows, truth, which):
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hits = [(r.predicted, truth[r.doc_id][which]) for r in held]
    recall = [np.mean([p == y for p, y in hits if y == k]) for k in (0, 1)]
    return recall


def test_held_out_accuracy(spark):
    docs, labels, truth = planted(spark)
    quality = quality_scores(docs, labels).collect()
    assert min(accuracy(quality, truth, 0)) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in quality)
    toxic = toxicity_scores(docs, labels).collect()
    assert min(accuracy(toxic, truth, 1)) > 0.85
    assert all(r.predicted == int(r.score >= 0.5) for r in toxic)
    assert quality_scores(docs.repartition(9), labels).orderBy("doc_id").collect() == sorted(quality, key=lambda r: r.doc_id)


def test_labels_of_the_test_fold_are_not_used(spark):
    docs, labels, truth = planted(spark, 400)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = (quality_scores(docs, x).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b


def test_risk_with_known_prior_gives_probabilities():
    rng = np.random.default_rng(0)
    p, prior = rng.normal(1, 1, size=(4000, 1)), 0.3
    u = np.concatenate([rng.normal(1, 1, size=(2400, 1)), rng.normal(-1, 1, size=(5600, 1))])
    w, bias = fit_nnpu(np.r_[np.ones(4000, bool), np.zeros(8000, bool)], np.concatenate([p, u]), prior, 1e-4)
    # the true log odds are 2 x + log(0.3 / 0.7)
    assert abs(w[0] - 2) < 0.4 and abs(bias - np.log(3 / 7)) < 0.4


def test_odd_rows(spark, odd, nothing):
    docs, labels, _ = planted(spark, 300)
    for scores in (quality_scores, toxicity_scores):
        got = scores(odd, labels.where("doc_id > 20")).collect()
        assert len(got) == 9 and all(r.score == 0.5 for r in got)  # none of the labelled texts is here
        assert scores(nothing, labels.limit(0)).count() == 0
        both = odd.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
        assert scores(both, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema))).count() == 309
    assert good_documents(docs, labels).columns == docs.columns


def test_prior_is_estimated_over_unlabelled_texts():
    rng = np.random.default_rng(3)
    for prior in (0.1, 0.4, 0.9):
        p = rng.normal(3, 1, 4_000)
        u = np.concatenate([rng.normal(3, 1, int(8_000 * prior)), rng.normal(-1, 1, 8_000 - int(8_000 * prior))])
        assert abs(estimate_prior(p, u) - prior) < 0.05


def test_the_sample_is_bounded_whatever_rows_share_an_id(spark):
    """A third of the rows have one id; labels name it too."""
    rows = [(1, f"text {i}") for i in range(300)] + [(i, f"other {i}") for i in range(10, 610)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), *[(i, i % 2, 0) for i in range(10, 110)]], "doc_id long, quality int, toxic int")
    picked, share = _sample(docs, labels, "quality", 20, 30, ())
    got = picked.collect()
    assert len(got) <= 50 and len({(r.doc_id, r.positive) for r in got}) == len(got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got) and 0.3 < share < 0.7
    assert {zlib.crc32(str(r.doc_id).encode()) % 5 for r in _sample(docs, labels, "quality", 20, 30, (2, 3))[0].collect()} <= {1, 4}


def test_settings_are_judged_without_the_test_fold(spark):
    docs, labels, _ = planted(spark, 400)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    a, b = (cross_validate(docs, x, "quality", [{"l2": 1e-4, "steps": 50}], 0.3, style=True, words=False) for x in (labels, turned))
    assert a == b and a[0][1] > 0.8
