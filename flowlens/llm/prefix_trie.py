"""The trie of conversation prefixes, built by van Emde Boas recursion on depth.

Every conversation is a sequence of turns, every distinct prefix a node. A trie of height 2^k is cut at half depth: the
cut prefixes get names, the upper trie and the forest below (each tree hanging from a named cut) have height 2^(k-1) and
are cut in turn, all of them in one round of Spark jobs. So log2(longest conversation) rounds name all nodes:

* first halves are compared through digests of blocks of 1, 2, 4, ... turns (a block's digest from its two halves);
* a cut prefix is known by (depth, name of the root it hangs from, digest of the half between). Its name is the smallest
  conversation id that has it: grouping finds it, a salted join gives it back to every conversation.

Then totals are grafted upward, again by halves: after round k every node has the totals of its subtree inside its
block of 2^(k+1) depths, because the cut nodes in the middle of the block hand theirs to the nodes above in the block.

Rows are (conversation, depth), never whole conversations, so one conversation may hold any share of all rows; its blocks
are different keys. Nodes that very many conversations share are partial sums and salted groups. Texts are read once and
leave the scan as digests and sizes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.storage import columns_of, stored

# Fixed values of the rebuilding rule.
FAMILY, HEADS = 5, 9
SALTS = 32
PIECE_BITS = 8  # ids per piece of a list of ids: 2^8


def _digest(text: Column) -> Column:
    """128 bits of SHA-256 as two numbers."""
    hexed = F.sha2(text, 256)
    return F.struct(*[F.conv(F.substring(hexed, at, 16), 16, -10).cast("long").alias(n) for n, at in (("hi", 1), ("lo", 17))])


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, part, at, hi, lo, bytes`` by conversation and turn, and per ``conv, part`` the position of its first row.

    Rows are range-partitioned and written once, so a conversation may span partitions and a retry finds the same places.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = columns_of(conversations, "conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("d"),
        F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.select("conv", "turn", "d.hi", "d.lo", "bytes")
    by = ["conv", F.col("turn").asc_nulls_first(), "hi", "lo"]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "hi", "lo", "bytes"), "turns")
    runs = placed.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # a row per conversation and partition: a conversation has at most as many as there are partitions
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed, stored(runs, "runs")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv, d, hi, lo, bytes`` (d from 1) of every rebuilt conversation, and ``conv, size`` of each, turnless ones too."""
    placed, runs = ordered_turns(conversations)
    conv = F.col("conv")
    base, head = conv - conv % FAMILY, (F.crc32(conv.cast("string")) % HEADS).cast("long")
    sizes = runs.groupBy("conv").agg(F.sum("n").alias("n"))
    heads = sizes.select("conv", "n", base.alias("base"), head.alias("head")).join(
        sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    heads = stored(heads.withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0).cast("long")))), "heads")
    # positions and shifts are joined per partition of a conversation, so a long one is many keys
    shift = runs.join(heads.select("conv", "head", "taken"), "conv").select("conv", "part", "first", "before", "head", "taken")
    own = placed.join(shift, ["conv", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before"))
    rest = own.where(F.col("pos") >= F.col("head")).select(
        "conv", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("d"), "hi", "lo", "bytes")
    # at most HEADS rows of a base meet at most 2 * FAMILY - 1 conversations
    start = own.where(F.col("pos") < HEADS - 1).select(F.col("conv").alias("base"), "pos", "hi", "lo", "bytes")
    lent = start.join(heads.where("taken > 0").select("conv", "base", "taken"), "base").where(F.col("pos") < F.col("taken")).select(
        "conv", (F.col("pos") + 1).alias("d"), "hi", "lo", "bytes")
    sizes = heads.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("size"))
    return stored(rest.unionByName(lent), "rebuilt"), sizes


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k ``conv, i, hi, lo, bytes``: digest of the turns from i * 2^k + 1 to (i + 1) * 2^k, and the size of the last."""
    found = [turns.select("conv", (F.col("d") - 1).alias("i"), "hi", "lo", "bytes")]
    for k in range(1, levels):
        odd = (F.col("i") % 2) == 1
        halves = found[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(
            *[F.max(F.when(~odd, F.col(c))).alias(f"l_{c}") for c in ("hi", "lo")],
            *[F.max(F.when(odd, F.col(c))).alias(f"r_{c}") for c in ("hi", "lo", "bytes")])
        whole = halves.where(F.col("r_hi").isNotNull()).withColumn("d", _digest(F.concat_ws(":", "l_hi", "l_lo", "r_hi", "r_lo")))
        found.append(stored(whole.select("conv", "i", "d.hi", "d.lo", F.col("r_bytes").alias("bytes")), f"blocks{k}"))
    return found


def _named(cuts: DataFrame) -> DataFrame:
    """Every row of ``cuts`` with ``name``, the smallest conversation with the same depth, root and digest."""
    key = ["d", "root", "hi", "lo"]
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)))
    least = salted.groupBy(*key, "salt").agg(F.min("conv").alias("least"))  # at most SALTS rows per prefix
    least = least.withColumn("name", F.min("least").over(Window.partitionBy(*key))).drop("least")
    return salted.join(least, [*key, "salt"]).select("conv", "d", "name", "bytes")


def name_prefixes(turns: DataFrame, sizes: DataFrame, levels: int, root: int) -> DataFrame:
    """``conv, d, name, bytes`` for every prefix of every conversation, the empty one included."""
    places = sizes.select("conv", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("name"), F.lit(0).cast("long").alias("bytes"))
    for k, blocks in reversed(list(enumerate(_blocks(turns, levels)))):
        half = 1 << k
        first = blocks.where(F.col("i") % 2 == 0).select("conv", (F.col("i") * half).alias("at"), "hi", "lo", "bytes")
        roots = places.select("conv", F.col("d").alias("at"), F.col("name").alias("root"))
        cuts = first.join(roots, ["conv", "at"]).select("conv", (F.col("at") + half).alias("d"), "root", "hi", "lo", "bytes")
        places = stored(places.unionByName(_named(cuts)), f"places{k}")
    return places


def graft(nodes: DataFrame, places: DataFrame, levels: int, totals: list[str]) -> DataFrame:
    """``d, name`` and every total summed over the node's subtree, itself included."""
    now = nodes.select("d", "name", *totals)
    paths = places.select("conv", F.col("d").alias("at"), F.col("name").alias("above"))
    for k in range(levels):
        middle = now.where(F.col("d") % (2 << k) == 1 << k).select(
            F.col("name").alias("conv"), (F.shiftright("d", k) - 1).alias("block"), *totals)
        up = middle.join(paths.withColumn("block", F.shiftright("at", k)), ["conv", "block"]).select(
            F.col("at").alias("d"), F.col("above").alias("name"), *totals)
        now = stored(now.unionByName(up).groupBy("d", "name").agg(*[F.sum(t).alias(t) for t in totals]), f"totals{k}")
    return now


def _hash_lists(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's pieces in order, joined by commas; fed to the hash as they pass, never held together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for d, name, ids in zip(*[batch.column(c).to_pylist() for c in ("d", "name", "ids")], strict=True):
                if (d, name) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, name), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["d", "name", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=["d", "name", "ends_sha256"])

    dealt = pieces.repartition("d", "name").sortWithinPartitions("d", "name", "piece")
    return dealt.select("d", "name", "ids").mapInArrow(run, "d long, name long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Columns read: ``conv_id, turn, role, text``; others may have any names. Rows without ``conv_id`` belong to no
    conversation. A null turn comes first; rows of one conversation with equal turns follow the order of their digests, and
    repeated rows are turns of their own. Null role or text is an empty one. Texts count whole, whatever their length. No
    conversation at all gives no row, not even a root.
    """
    turns, sizes = rebuilt_turns(conversations)
    sizes = stored(sizes, "sizes")
    longest, root = sizes.agg(F.max("size"), F.min("conv")).first()
    levels = max(int(longest or 0), 1).bit_length()
    places = name_prefixes(turns, sizes, levels, root or 0)

    ends = places.join(sizes.select("conv", F.col("size").alias("d")), ["conv", "d"])
    pieces = ends.groupBy("d", "name", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = _hash_lists(pieces)

    counts = places.groupBy("d", "name").agg(F.count(F.lit(1)).alias("n_convs"))
    own = places.where(F.col("conv") == F.col("name")).select("d", "name", "bytes")  # one row per node
    parents = places.select(F.col("conv").alias("name"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = stored(counts.join(own, ["d", "name"]).join(parents, ["d", "name"], "left"), "nodes")
    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["d", "name"], "left").fillna(0, ["n_children"]), "children")
    weighed = nodes.select("d", "name", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                           ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = graft(weighed, places, levels, ["n_leaves", "saved_tokens"])
    none = hashlib.sha256(b"").hexdigest()
    return nodes.join(totals, ["d", "name"]).join(ends, ["d", "name"], "left").select(
        F.col("name").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
