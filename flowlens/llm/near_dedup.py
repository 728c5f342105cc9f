"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find groups.

A document's set is its distinct ``words``-word shingles (A-Z lower-cased; a shorter text is one shingle;
a text without words has an empty set and no links). Two documents are linked when
100 * intersection >= ``percent`` * union.

1. One scan makes the signature of every text, keeps its band keys and a 128-bit hash of its set.
2. Equal sets collapse onto their smallest doc_id; only these representatives go on.
3. In every bucket of a band, each member is compared with the bucket's smallest id; links that hold
   on the full sets are joined to groups.
4. What is still apart inside a bucket (members outside the group of its smallest id) is compared with
   every member of another group of that bucket, so no candidate of the banding is left out. That happens in
   blocks: full sets of at most ``BLOCK`` members each meet inside a task, and only the links between groups
   leave it. A large group of copies costs one comparison per member.
5. All links together give the groups.

With 32 bands of 5 rows a pair at the limit of 0.75 meets in some band with probability 0.9998.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import connected_components
from flowlens.llm.storage import columns_of, numbered, stored
from flowlens.llm.superminhash import band_keys, signatures
from flowlens.llm.words import distinct_shingles, mix, words_of

_SALT = np.uint64(0x5851F42D4C957F2D)
BLOCK = 128
_COLUMNS = 4_096


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def sketch_documents(docs: DataFrame, words: int = 5, bands: int = 32, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, bands``: set size, 128-bit hash of the set, one key per band."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words_of(batch.column("text"), lower=True):
                values, at = distinct_shingles(w, words)
                keys = band_keys(signatures(values, at, bands * rows), bands).view(np.int64)
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(w.first, n), pa.array(np.diff(at)),
                    pa.array(_sums(mix(values), at).view(np.int64)),
                    pa.array(_sums(mix(values ^ _SALT), at).view(np.int64)),
                    pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), keys.ravel()),
                ], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return columns_of(docs, "doc_id", "text").mapInArrow(
        sketch, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose full shingle sets are similar enough."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = np.zeros(len(a), dtype=bool)
            left = _sets(batch.column("text_a"), a, words)
            right = _sets(batch.column("text_b"), None, words)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                least = min(len(x), len(y))
                if 100 * least < percent * max(len(x), len(y)) or not least:
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    first = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(hold, "a long, b long")


def _sets(texts: pa.Array, owners: pa.Array | None, words: int) -> Iterator[np.ndarray]:
    """The set of each text in turn; a run of rows with the same owner is worked out once."""
    if owners is not None and len(owners):
        ids = owners.to_numpy(zero_copy_only=False)
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        which = np.cumsum(new) - 1
        own = list(_sets(texts.filter(pa.array(new)), None, words))
        yield from (own[i] for i in which)
        return
    for w in words_of(texts, lower=True):
        values, at = distinct_shingles(w, words)
        for j in range(len(at) - 1):
            yield values[at[j]:at[j + 1]]


def _meetings(placed: DataFrame, block: int) -> DataFrame:
    """Rows of ``band, doc_id, group, main`` dealt to meetings ``band, x, y`` of at most about two blocks.

    Members outside the main group (apart) meet all others: blocks of them with blocks of the main group, and with one
    another. Members of the main group never meet each other.
    """
    counts = placed.groupBy("band").agg(
        F.count_if(F.col("group") == F.col("main")).alias("_in"), F.count_if(F.col("group") != F.col("main")).alias("_apart"))
    rows = placed.join(counts, "band").withColumns({
        "_in": F.ceil(F.col("_in") / F.lit(block)).cast("int"), "_apart": F.ceil(F.col("_apart") / F.lit(block)).cast("int")})
    apart = F.col("group") != F.col("main")
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(apart, F.col("_apart")).otherwise(F.col("_in"))).cast("int")

    def each(n: str, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda other: F.struct(*make(other)))

    with_main = each("_in", lambda o: (F.col("_own").alias("x"), o.alias("y")))
    with_apart = each("_apart", lambda o: (F.least("_own", o).alias("x"), (F.col("_in") + F.greatest("_own", o)).alias("y")))
    of_main = each("_apart", lambda o: (o.alias("x"), F.col("_own").alias("y")))
    places = F.when(apart, F.concat(with_main, with_apart)).otherwise(of_main)
    rows = rows.withColumn("_own", own).select("band", "doc_id", "group", F.explode(places).alias("_at"))
    return rows.select("band", "doc_id", "group", "_at.x", "_at.y")


def shared_counts(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets share; ``owner`` tells the set of each value."""
    order = np.argsort(values, kind="stable")
    v, r = values[order], owner[order]
    new = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=bool)
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1 if len(v) else new
    r, column = r[often], column[often]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        grid = np.zeros((n, _COLUMNS), dtype=np.float32)
        grid[r[a:b], column[a:b] - lo] = 1
        out += grid @ grid.T
    return out


def _links_between_groups(meetings: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links ``a, b`` between group ids, one per group and meeting at most, from full sets."""

    def meet(table: pa.Table) -> pa.Table:
        group = table["group"].to_numpy()
        values, owner, sizes = [], [], np.zeros(len(group), dtype=np.int64)
        if (group != group[0]).any():
            for i, own in enumerate(_sets(table["text"].combine_chunks(), None, words)):
                sizes[i] = len(own)
                values.append(own)
                owner.append(np.full(len(own), i))
        if not values:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        shared = shared_counts(np.concatenate(values), np.concatenate(owner), len(group))
        linked = (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (shared > 0)
        left, right = np.nonzero(linked & (group[:, None] != group[None, :]))
        names, member = np.unique(group, return_inverse=True)
        label = names.copy()
        while True:
            new = label.copy()
            np.minimum.at(new, member[left], label[member[right]])
            if (new == label).all():
                break
            label = new
        tied = label != names
        return pa.table({"a": label[tied], "b": names[tied]})

    rows = meetings.join(texts, "doc_id").select("band", "x", "y", "group", "text")
    return rows.groupBy("band", "x", "y").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, bands: int = 32, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id long, text string``).

    component_id is the smallest doc_id reachable over links. Null and empty texts, and texts of white
    space, have size 0 and stand alone. Rows that share a doc_id are one node; each is returned. A null
    doc_id stands alone with a null component and is kept. Extra columns are ignored; an empty table gives an empty result.
    """
    seen = stored(sketch_documents(docs, words, bands, rows), "sketches")
    filled = seen.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = filled.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    same = filled.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"])
    copies = stored(same.select("doc_id", "rep").distinct(), "copies")

    reps = filled.join(copies.where(F.col("doc_id") == F.col("rep")).select("doc_id"), "doc_id", "left_semi")
    places = reps.select("doc_id", F.explode("bands").alias("band")).distinct()
    centers = places.groupBy("band").agg(F.min("doc_id").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    places = stored(places.join(centers.select("band", "center"), "band"), "buckets")

    # the texts of all candidates, once; rows of one doc_id with different texts are all tried
    texts = docs.select(F.col("doc_id"), F.col("text")).join(places.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = stored(texts, "candidates")
    stars = places.where("doc_id != center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = stored(_verified(stars, texts, words, percent), "star_links")

    groups = connected_components(first)
    placed = places.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    placed = placed.select("band", "doc_id", F.coalesce("component", "doc_id").alias("group"))
    split = placed.groupBy("band").agg(F.min("group").alias("main"), F.max("group").alias("_last")).where("main < _last")
    placed = placed.join(split.select("band", "main"), "band")
    second = stored(_links_between_groups(_meetings(placed, BLOCK), texts, words, percent).distinct(), "group_links")

    links = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).unionByName(first).unionByName(second)
    found = connected_components(links)
    out = seen.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how: int) -> DataFrame:
    """One document of each group: the one with the smallest doc_id. Columns of ``docs`` stay as they are, whatever their names.

    Every row is a document of its own: rows that share an id are judged by their own texts, rows without an id take
    part and stay only where their group has no id at all, and of rows that tie (equal ids, or none) one stays. Texts
    without words are linked with nothing, so all of them stay. An empty table gives an empty result.
    """
    rows, row = numbered(docs, "numbered")
    nodes = rows.select(F.col(row).alias("doc_id"), F.col("text"))
    found = near_duplicates(nodes, **how).select(F.col("doc_id").alias("node"), F.col("component_id").alias("component"))
    large = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    ids = rows.select(F.col(row).alias("node"), F.col("doc_id").alias("id"))
    members = stored(found.join(large, "component", "left_semi").join(ids, "node"), "members")
    least = members.groupBy("component").agg(F.min("id").alias("least"))
    tied = members.join(least, "component").where(F.col("id").eqNullSafe(F.col("least")))
    lost = members.join(tied.groupBy("component").agg(F.min("node").alias("stays")), "component").where("node != stays")
    return rows.join(lost.select(F.col("node").alias(row)), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
