import random

from brute_trie import prefix_trie as plain
from conftest import CLASHING

from flowlens.llm.prefix_trie import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def table(seed, ids, depth=12):
    rng = random.Random(seed)
    rows = []
    for c in ids:
        n = rng.choice([1, 2, 3, 5, depth])
        kind = rng.randrange(3)  # conversations of one kind begin alike
        for t in range(n):
            text = f"k{kind} t{t}" if t < rng.choice([1, 2, 4, 6]) else f"own {rng.randrange(4)} {'é' * rng.randrange(5)}"
            rows.append((c, t if t or rng.random() < 0.8 else None, rng.choice(["user", "user", None]) if t > 6 else "user", text))
    rng.shuffle(rows)
    return rows


def check(spark, rows, parts=3):
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts)).select(*COLUMNS).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_against_plain_trie_with_negative_and_far_ids(spark):
    check(spark, table(1, [*range(-12, 40), 10 ** 15 + 3, 10 ** 15, 2 ** 62 + 1, -(2 ** 62) - 3]))


def test_third_of_all_rows_in_one_conversation_and_many_equal_ones(spark):
    rows = [(3, t, "user", f"turn {t}") for t in range(70)]
    rows += [(100 + c, t, "user", "same") for c in range(100) for t in range(2)]
    check(spark, rows, 5)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (2, 5, "", "x" * 100_000), (2, 6, None, "\x00 ü 漢"), (None, 1, "user", "lost"), (7, 1, "a", "b"), (7, 2, "a", "b")]
    check(spark, rows)
    wide = spark.createDataFrame([(*r, *CLASHING.values(), 1, 2, 3) for r in rows],
                                 SCHEMA + ", " + ", ".join(f"`{k}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in CLASHING.items())
                                 + ", conv int, d int, hi int")
    assert {tuple(r) for r in prefix_trie(wide).select(*COLUMNS).collect()} == plain(rows)
    assert prefix_trie(wide.limit(0)).count() == 0
    assert prefix_trie(wide.where("conv_id is null")).count() == 0


def test_turns_that_share_a_number_are_all_there(spark):
    rows = [(9, 1, "user", "b"), (9, 1, "user", "a"), (9, 1, "user", "a"), (11, 1, "user", "c")]
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    again = prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA).repartition(4)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in again}
    assert max(r.depth for r in got) <= 3
