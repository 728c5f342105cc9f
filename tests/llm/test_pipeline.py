import duckdb
import public_tokenizers
import pytest
from brute import near_duplicates, secrets, words
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from flowlens.llm.oracles import NEAR_DUPLICATES, NEAR_VECTORS, WITHOUT_REPEATS
from flowlens.llm.storage import read_table

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The table after each stage."""
    docs, out = read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, stage(spark, docs, SF)))
        docs = out[-1][2]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_dedup", "secrets", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    good = {r.doc_id for r in read_table(spark, SF, "labels").where("quality = 1").collect()}
    bad = {r.doc_id for r in read_table(spark, SF, "labels").where("quality = 0").collect()}
    left = set(texts(after))
    assert len(good & left) > 0.95 * len(good) and len(bad & left) < 0.4 * len(bad)


def test_one_document_of_each_group(stages):
    _, before, after = stages[1]
    want = near_duplicates(list(texts(before).items()))
    assert texts(after) == {d: t for d, t in texts(before).items() if want[d][2]}


def test_secrets_are_masked(stages):
    _, before, after = stages[2]
    old, new = texts(before), texts(after)
    assert set(old) == set(new) and any(secrets(t) for t in old.values())
    for d, t in new.items():
        assert not secrets(t)
        assert t == old[d] if not secrets(old[d]) else "[SECRET]" in t
    assert all(r.n_chars == len(r.text) for r in after.collect() if r.text != old[r.doc_id])


def test_mix_repeats_whole_documents(stages):
    _, before, after = stages[3]
    old, rows = texts(before), after.collect()
    size = sum(len(words(t)) for t in old.values())
    assert all(r.text == old[r.doc_id] for r in rows)
    assert abs(sum(len(words(r.text)) for r in rows) - 1.5 * size) < 0.15 * size


def test_sequences_hold_the_mix(stages):
    _, before, after = stages[4]
    model, pieces = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), after.collect()
    want = sum(len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect())
    fill = {}
    for p in pieces:
        fill[p.sequence_id] = fill.get(p.sequence_id, 0) + p.length
    assert sum(fill.values()) == want and max(fill.values()) <= 1024 and want > 0.98 * 1024 * len(fill)


def test_registered(spark):
    names = entry_module.queries()
    assert "pipeline" in names and sorted(n.split("_")[0] for n in names if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 14))
    assert names["pipeline"](spark, SMALL).columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_sql_twins_hold_odd_rows(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, NULL), (2, ''), (3, 'A b'), (4, 'a  b'), (5, 'c')) t(doc_id, text)")
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (1, [1.0::float, 0]), (2, [2.0::float, 0]), (3, [0.0::float, 0]), (4, NULL)) t(vec_id, embedding)")
    assert sorted(con.execute(NEAR_DUPLICATES).fetchall()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True)]
    assert [r[1:3] for r in sorted(con.execute(WITHOUT_REPEATS).fetchall())] == [(0, 0), (0, 0), (2, 0), (2, 0), (1, 0)]
    assert sorted(con.execute(NEAR_VECTORS).fetchall()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
