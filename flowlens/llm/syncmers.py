"""Document fingerprints from closed syncmers, in DataFrame functions only.

The text's words are hashed; a k-mer is ``k`` consecutive words, its inner substrings are its word pairs.
A k-mer is an anchor (a closed syncmer) when its smallest inner pair stands at one of its two edges. That
depends on the k-mer alone, so the same passage gives the same anchors in any context. A fingerprint holds
the hashes of all anchors in text order, so an anchor's place is its position; nothing is left out.

Likeness of two fingerprints: of the distinct hashes of both together, the share that both have at places
moved by about the same distance (first occurrences count), turned into 2 * shared / (sum of sizes). Equal
texts have likeness 1, also those without words; texts of fewer than k words have one anchor, all their words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.storage import WORD, stored

K = 6
DRIFT = 16
_PLACE = 0x7FFFFFFF


def anchors(rows: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds ``out``: the hashes (ints) of all anchors of a text without nulls, in text order."""
    words, pairs = f"_{out}_words", f"_{out}_pairs"
    inner = k - 1
    rows = rows.withColumn(words, F.transform(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    rows = rows.withColumn(pairs, F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    many = F.greatest(F.size(pairs) - inner + 1, F.lit(0))
    kmers = F.arrays_zip(*[F.slice(pairs, j + 1, many).alias(f"p{j}") for j in range(inner)])

    def closed(x: Column) -> Column:
        return F.least(x["p0"], x[f"p{inner - 1}"]) <= F.least(*[x[f"p{j}"] for j in range(inner)])

    hashes = F.transform(F.filter(kmers, closed), lambda x: F.hash(*[x[f"p{j}"] for j in range(0, inner, 2)], x[f"p{inner - 1}"]))
    whole = F.when(F.size(words) > 0, F.array(F.hash(F.col(words)))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn(out, F.when(F.size(words) >= k, hashes).otherwise(whole)).drop(words, pairs)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def likeness(a: str, b: str, drift: int = DRIFT) -> Column:
    """0 to 1 from two fingerprint columns; both are sorted together, so the work is n log n in their sizes."""
    def marks(side: int, hashes: str) -> Column:
        """Hash, side and place of each anchor in one number."""
        return F.transform(hashes, lambda h, i: F.shiftleft(h.cast("long"), 32).bitwiseOR(F.lit(side << 31).cast("long")).bitwiseOR(i.cast("long")))

    def firsts(marked: Column) -> Column:
        """The first place of each hash on each side."""
        return F.filter(marked, lambda x, i: F.coalesce(F.shiftright(x, 31) != F.shiftright(F.get(marked, i - 1), 31), F.lit(True)))

    def moves(marked: Column) -> Column:
        """How far each hash that both have stands from one text to the other; its two marks are neighbours."""
        return F.filter(F.transform(marked, lambda x, i: F.when(
            F.shiftright(x, 32) == F.shiftright(F.get(marked, i + 1), 32),
            F.get(marked, i + 1).bitwiseAND(F.lit(_PLACE)) - x.bitwiseAND(F.lit(_PLACE)))), lambda m: m.isNotNull())

    def agreeing(moved: Column) -> Column:
        """Of the anchors in both, those that moved as far as the middle one, give or take the drift."""
        middle = F.try_element_at(F.sort_array(moved), (F.floor(F.size(moved) / 2) + 1).cast("int"))
        return _let(middle, lambda m: F.size(F.filter(moved, lambda x: F.abs(x - m) <= drift)))

    def score(marked: Column) -> Column:
        share = _let(moves(marked), lambda m: agreeing(m) / (F.size(marked) - F.size(m)).cast("double"))
        return F.when(F.size(marked) == 0, F.lit(1.0)).otherwise(_let(share, lambda s: 2 * s / (1 + s)))

    return _let(F.sort_array(F.concat(marks(0, a), marks(1, b))), lambda both: _let(firsts(both), score))


def as_text(fingerprint: str) -> Column:
    """Eight hexadecimal digits per anchor, in text order."""
    return F.array_join(F.transform(fingerprint, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def successors(ids: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds ``next_id`` to a table of distinct ``doc_id``: ascending, null first; after the last comes the first.

    Ids are range-partitioned and stored, so no task sees more than its range; only the first id of each range
    is ordered globally.
    """
    parts = parts or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").asc_nulls_first()
    placed = ids.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, "ids")
    edges = placed.groupBy("_part").agg(
        F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("id"))).alias("_first"))
    every = Window.orderBy("_part")
    edges = edges.select("_part", F.coalesce(
        F.lead("_first").over(every), F.first("_first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_edge"))
    following = F.lead(F.struct(F.col("doc_id").isNotNull().alias("given"), F.col("doc_id").alias("id"))).over(
        Window.partitionBy("_part").orderBy(order))
    placed = placed.withColumn("_next", following).join(edges, "_part")
    return placed.withColumn("next_id", F.coalesce("_next", "_edge")["id"]).drop("_part", "_next", "_edge")


def edited_fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text``; null text: empty): its fingerprint, and that of its edited text.

    The edited text ends, in place of its last floor(n_chars / 4) code points, with as many of the first of the
    next document (or all it has); next means the next larger doc_id, after the largest the smallest. Of rows
    that share an id the one with the largest text hash is the id's document for its predecessor. Every row is
    returned, a null id as the smallest. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # both joins below read the same two columns by the same key, so the texts are dealt out once; anchors are made after it
    # an id needs of its successor at most a quarter of its own length
    quarter = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).cast("int")
    ids = successors(docs.groupBy("doc_id").agg(F.max(quarter).alias("_most")))
    ids = ids.select(F.col("doc_id").alias("_for"), F.col("next_id").alias("_of"), "_most")
    given = anchors(base.join(ids, base["doc_id"].eqNullSafe(F.col("_of"))), "text", "next", k).select(
        "_for", F.struct(F.xxhash64("text").alias("rank"), F.substring("text", F.lit(1), F.col("_most")).alias("start"), "next").alias("_g"))
    given = given.groupBy("_for").agg(F.max("_g").alias("_g"))
    rows = base.join(given, base["doc_id"].eqNullSafe(F.col("_for")))
    cut = F.floor(F.length("text") / 4).cast("int")
    rows = anchors(rows, "text", "own", k).select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", F.col("_g.next").alias("next"), F.concat(
        F.substring("text", F.lit(1), F.length("text") - cut), F.substring(F.col("_g.start"), F.lit(1), cut)).alias("edited_text"))
    return anchors(rows, "edited_text", "edited", k)


def fingerprint_digest(docs: DataFrame, k: int = K) -> DataFrame:
    """The columns of the registered query: fingerprints as text, the edited text's hash, both likenesses."""
    rows = edited_fingerprints(docs, k)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"),
        likeness("own", "next").alias("near_next"))
