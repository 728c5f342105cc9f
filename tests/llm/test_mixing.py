import pytest
from brute import words
from pyspark.sql import functions as F

from flowlens.llm.mixing import invert, mix_summary, mixed_documents, training_positions
from flowlens.llm.mixing import _segments


def plain_targets(sizes, share=1.5, most=2.0):
    """Excess above the limit is dealt to the rest again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_now, left = {}, set(names), share * sum(sizes.values())
    while open_now:
        total = sum(weight[s] for s in open_now)
        full = {s for s in open_now if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_now}
        for s in full:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in full)
        open_now -= full
    return target


def test_targets_and_words_taken(docs, rows):
    got = mix_summary(docs).collect()
    sizes = {}
    for d, t in rows:
        sizes[f"s{d % 3}"] = sizes.get(f"s{d % 3}", 0) + len(words(t))
    want, taken = plain_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        source = f"s{r.doc_id % 3}"
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1


def test_reruns_agree_whatever_the_partitioning(docs):
    a, b = mix_summary(docs), mix_summary(docs.repartition(7))
    assert sorted(a.collect()) == sorted(b.collect())


def test_a_schedule_is_followed(spark):
    """Tokens trained on until a time are the schedule's integral up to it."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w " * 5).alias("text"), F.lit("a").alias("source"))
    uses = training_positions(docs, weights=(1.0,), share=1.0, curriculum=(((0.0, 3.0), (1.0, 1.0)),)).select(F.explode("uses").alias("u"))
    early = uses.where("u.position < 0.5").count()
    assert abs(early - 4000 * (2.5 / 4)) < 10


def test_invert(spark):
    flat = _segments(((0.0, 1.0), (1.0, 1.0)))
    ramp = _segments(((0.0, 0.0), (0.5, 1.0), (1.0, 0.0)))
    row = spark.range(1).select(invert(flat, F.lit(0.25)), invert(ramp, F.lit(0.5)), invert(ramp, F.lit(0.125)), invert(ramp, F.lit(0.0))).first()
    assert list(row) == pytest.approx([0.25, 0.5, 0.25, 0.0])


def test_odd_rows(odd, nothing):
    got = mix_summary(odd).collect()
    assert len(got) == 9 and mix_summary(nothing).count() == 0
    assert all(r.taken == 0 for r in got if r.size == 0)
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns and {r.doc_id for r in mixed.collect()} <= {None, 5, 7, -3}
    assert mixed_documents(nothing).count() == 0


def test_documents_are_repeated_whole(docs, rows):
    got = mixed_documents(docs).collect()
    assert {r.text for r in got} <= {t for _, t in rows} and len(got) > len({r.doc_id for r in got})


def test_rows_that_share_an_id_are_mixed_alone(spark):
    """What is mixed comes near the targets, however rows are named."""
    rows = [(None if i % 3 else 4, f"w{i} " * (1 + i % 7), "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    targets = {r.source: r.target for r in training_positions(docs).select("source", "target").distinct().collect()}
    mixed = {}
    for r in mixed_documents(docs).collect():
        mixed[r.source] = mixed.get(r.source, 0) + len(words(r.text))
    assert all(abs(mixed[s] - targets[s]) <= 7 for s in targets)
