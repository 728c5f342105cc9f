import random

from brute_trie import filter_audit as plain

from flowlens.llm.filter_audit import FilterAudit, audit_filters, interactions, known_labels

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def documents(seed=1, n=90):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        w = [f"w{rng.randrange(rng.choice([20, 400]))}" for _ in range(rng.choice([3, 49, 50, 80]))]
        if rng.random() < 0.2:
            w = [x.upper() for x in w]
        if rng.random() < 0.2:
            w.insert(0, rng.choice("#$%&*|"))
        texts.append(" ".join(w))
    texts += [rng.choice(texts) for _ in range(n // 2)] + [None, "", "", "\n"]
    ids = rng.sample(range(10_000), len(texts))
    return [(d, t, rng.choice(["a", "a", "b", None])) for d, t in zip(ids, texts, strict=True)]


def labelled(docs, seed=2):
    rng = random.Random(seed)
    return [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in docs if d is not None and rng.random() < 0.6]


def written(spark, docs, path, files):
    """One file after the other, so that their order is known."""
    size = -(-len(docs) // files)
    for k in range(files):
        spark.createDataFrame(docs[k * size:(k + 1) * size], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(path)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def got(df):
    rows = [tuple(r) for r in df.select(*COLUMNS).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_plain_version_over_many_batches(spark, tmp_path):
    docs = documents()
    labels = labelled(docs)
    path = str(tmp_path / "down")
    written(spark, sorted(docs, reverse=True), path, 4)
    assert got(audit_filters(spark, path, labels_of(spark, labels), batches=4)) == plain(docs, labels)


def test_smaller_ids_retract_earlier_masks(spark, tmp_path):
    """One text whose ids fall from batch to batch: only the last one is no copy, whatever its part."""
    docs = [(100 - k, "the same text " * 20, "ab"[k % 2]) for k in range(6)]
    path = str(tmp_path / "t")
    written(spark, docs, path, 6)
    audit = FilterAudit(str(tmp_path / "audit"), known_labels(labels_of(spark, [(95, 1, 0), (100, 1, 1)])))
    audit.run_available(spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(path))
    counters = {(r.part, r["mask"], r.good, r.toxic): r.n for r in audit.counters(spark).collect()}
    assert counters == {("a", 18, 0, 0): 2, ("a", 18, 1, 1): 1, ("b", 18, 0, 0): 2, ("b", 2, 1, 0): 1}


def test_new_files_go_on_and_a_batch_run_again_changes_nothing(spark, tmp_path):
    docs = documents(5)
    labels = labelled(docs)
    path, half = str(tmp_path / "t"), len(docs) // 2
    audit = FilterAudit(str(tmp_path / "audit"), known_labels(labels_of(spark, labels)))

    def run():
        audit.run_available(spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", 1).parquet(path))

    written(spark, docs[half:], path, 2)
    run()
    written(spark, docs[:half], path, 2)
    run()
    assert got(interactions(audit.counters(spark))) == plain(docs, labels)
    # the last batch once more, as after a failure before its commit
    size = -(-half // 2)
    audit.update(spark.createDataFrame(docs[:half][size:], "doc_id long, text string, source string"), 3)
    assert got(interactions(audit.counters(spark))) == plain(docs, labels)


def test_odd_rows(spark, odd, nothing, tmp_path):
    path = str(tmp_path / "odd")
    odd.repartition(3).write.parquet(path)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    labels = [(5, 1, None), (5, None, 1), (None, 1, 1), (7, 0, 1)]
    assert got(audit_filters(spark, path, labels_of(spark, labels))) == plain(rows, labels)
    nothing.write.parquet(str(tmp_path / "none"))
    assert audit_filters(spark, str(tmp_path / "none"), labels_of(spark, [])).count() == 0


def test_hot_text_and_rows_without_ids(spark, tmp_path):
    docs = [(k, "one text for a third of all rows", "s") for k in range(300)] + [(None, "one text for a third of all rows", None)] * 300
    docs += [(1000 + k, " ".join(f"v{k}_{i}" for i in range(60)), "s") for k in range(30)]
    path = str(tmp_path / "t")
    written(spark, docs, path, 3)
    assert got(audit_filters(spark, path, labels_of(spark, [(0, 1, 1)]), batches=2)) == plain(docs, [(0, 1, 1)])
