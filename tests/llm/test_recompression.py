import random

from brute import without_repeats as plain

from flowlens.llm.recompression import row_key, without_repeats


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_against_every_window(docs, rows):
    want = plain(rows)
    assert sum(v[1] for v in want.values()) > 500
    assert result(without_repeats(docs)) == want


def test_runs_of_one_word_and_few_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("ab") if i % 2 else "a" for _ in range(rng.randint(0, 70)))) for i in range(40)]
    for rounds in (0, 1, 3):
        assert result(without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rounds=rounds)) == plain(rows)


def test_odd_rows(odd, nothing):
    got = without_repeats(odd)
    rows = got.collect()
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and len(rows) == 9
    assert [r.n_words for r in rows if r.doc_id == 9] == [0] and without_repeats(nothing).count() == 0
    # of "twice the same row" 12 times only the first 20 words and 3 more start nowhere earlier
    assert [r.n_removed for r in rows if r.doc_id == 7] == [44, 44]


def test_shared_and_missing_ids_in_any_layout(spark, rows):
    """Rows with one id or none are documents of their own, however they are batched."""
    given = [(None if d % 3 == 0 else 7 if d % 3 == 1 else -(1 << 63) + d % 2, t) for d, t in rows]
    # a shared passage at equal and at different starts, a whole copy without an id, an equal row with an id
    said = " ".join(f"said{i}" for i in range(30))
    given += [(None, said + " one end"), (None, said + " other end"), (None, "put before " + said), (7, said + " third end")]
    given += [(None, f"{said} copied {said}")] * 3 + [(7, " ".join(f"x{i % 25}" for i in range(60)) + " y" * 9 + " z" * 40)] * 2
    df = spark.createDataFrame(given, "doc_id long, text string")
    least = -(1 << 63)
    ordered = sorted(df.withColumn("key", row_key()).collect(), key=lambda r: (least if r.doc_id is None else r.doc_id, r.key))
    numbers, want = {}, []
    for i, r in enumerate(ordered):
        if r.doc_id is None or (r.doc_id, r.key) not in numbers:
            numbers[(r.doc_id, r.key, i) if r.doc_id is None else (r.doc_id, r.key)] = (i, r)
    results = plain([(i, r.text) for i, r in numbers.values()])
    for i, r in enumerate(ordered):
        n = i if r.doc_id is None else numbers[(r.doc_id, r.key)][0]
        want.append((r.doc_id, *results[n]))
    for parts, batch in ((1, 10_000), (1, 1), (4, 2)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = [tuple(r) for r in without_repeats(df.repartition(parts)).collect()]
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(got, key=repr) == sorted(want, key=repr)
