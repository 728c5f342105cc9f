import numpy as np
from brute import near_duplicates as plain
from brute import shingles

from flowlens.llm.near_dedup import drop_near_duplicates, near_duplicates
from flowlens.llm.superminhash import EMPTY, signatures


def test_against_all_pairs(docs, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()}
    want = plain(rows)
    assert len({v[1] for v in want.values()}) < len(rows) - 20
    assert got == want


def test_group_whose_smallest_member_is_far_from_the_rest(spark):
    """The bucket's smallest id links with few; the others must still find one another."""
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base[:150] + [f"x{i}" for i in range(50)]))]
    for k in range(1, 60):
        own = list(base)
        own[(k * 3) % 200] = f"e{k}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: v[1] for d, v in plain(rows).items()}


def test_odd_rows(odd, nothing):
    got = near_duplicates(odd).collect()
    assert len(got) == 9 and near_duplicates(nothing).count() == 0
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(d, d) for d in (-3, 5, 7, 9, 11)}
    assert [r.n_shingles for r in got if r.doc_id == 9] == [0]
    assert drop_near_duplicates(odd).columns == odd.columns and drop_near_duplicates(nothing).count() == 0


def test_stage_keeps_one_row_of_each_group(odd, spark):
    """Also where rows repeat whole, share an id or have none."""
    left = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in drop_near_duplicates(odd).collect())
    want = {(r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd.collect()}
    assert left == sorted(want)
    many = " ".join(f"w{i}" for i in range(40))
    rows = [(None, many)] * 4 + [(8, many + " end")] * 3 + [(3, "other words of this one")] + [(None, "none has an id here")] * 2 + [(8, "")] * 2
    rows += [(20 + i, many) for i in range(60)]
    got = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == [
        (-1, "none has an id here"), (3, "other words of this one"), (8, ""), (8, ""), (8, many + " end")]


def test_signatures_estimate_the_likeness_of_sets():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    a, b = np.unique(x[:700]), np.unique(x[200:])
    s = signatures(np.concatenate([a, b, a[:3]]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 3, len(a) + len(b) + 3]), 160)
    assert abs((s[0] == s[1]).mean() - 500 / 900) < 0.15
    assert (s[3] == EMPTY).all() and (s[2] != EMPTY).all()
    # every slot of a set of three is hit, in its smallest step
    assert len(set(s[2] >> 24)) > 50


def test_shingles_lower_only_ascii():
    assert shingles("A b C d É") == shingles("a B c D É") != shingles("a b c d é")
