"""Mixing sources to target weights with a time-varying curriculum, in DataFrame operations only.

Every source has a weight schedule over training time 0 to 1. Its integral is the source's total demand;
a document whose words start at share u of that demand is trained at the time when the integral reaches
u. So each source is laid out in an order of its own (a seeded hash), running word counts give each
document its share, the integral is inverted there, and documents are range-sorted by the time found.

Running counts go in three levels (source, 64 x 64 hash buckets, rows of a bucket), so a source with a
third of all rows is never ordered in one task. Per source there is one row of totals; only those rows
(as many as there are sources) are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.storage import WORD, numbered, stored

#: Relative demand at the times 0 and 1 (straight lines between the knots), dealt to sources in their order.
CURRICULUM = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
WEIGHTS = (5.0, 2.0, 1.0)
FAN = 64

Schedule = Sequence[tuple[float, float]]


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(schedule: Schedule) -> Column:
    """The schedule as an array of pieces: start, width, height and slope, and the part of the integral before it."""
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, t1 - t0, w0, (w1 - w0) / (t1 - t0), done))
        done += (w0 + w1) / 2 * (t1 - t0)
    return F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(w / done).alias("w"), F.lit(s / done).alias("s"), F.lit(c / done).alias("c"))
        for t, d, w, s, c in pieces])


def invert(segments: Column, u: Column) -> Column:
    """The time at which the integral over the segments (1 in total) reaches u."""
    piece = F.element_at(F.filter(segments, lambda p: (p["c"] <= u) | (p["c"] <= 0)), -1)
    need = u - piece["c"]
    root = F.sqrt(F.greatest(piece["w"] * piece["w"] + 2 * piece["s"] * need, F.lit(0.0)))
    width = F.when(piece["w"] + root > 0, 2 * need / (piece["w"] + root)).otherwise(F.lit(0.0))
    return piece["t"] + F.least(F.greatest(width, F.lit(0.0)), piece["d"])


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                   curriculum: Sequence[Schedule] = CURRICULUM) -> DataFrame:
    """Per source: ``source, source_size, target, segments``.

    Sources in code point order (null last) take the weights in turn and share ``share`` times all words by
    weight. No target passes ``most`` times its source's size: the sources for which size / weight is least
    are filled first, and what they leave is shared by weight among the rest.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    totals = totals.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(curriculum)))
    segments = F.element_at(F.array(*[_segments(s) for s in curriculum]), (turn + 1).cast("int"))
    totals = totals.withColumn("segments", segments).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    totals = totals.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_weights": F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(everything) * F.lit(float(share)),
    })
    level = F.greatest(F.col("_all") - F.col("_before"), F.lit(0.0)) / F.col("_weights")
    full = F.col("_cap") <= level * F.col("_weight")
    # from the first source that is not filled on, the level stays as it is there
    first = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    held = F.first(F.when(~full, level), ignorenulls=True).over(first)
    totals = totals.withColumn("_held", held)
    target = F.when(F.col("_held").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_held") * F.col("_weight")))
    return totals.select("source", "source_size", target.cast("double").alias("target"), "segments")


def _running(sized: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``_start``: words of the documents that come before, within the source's hash order."""
    h = sized.withColumn("_h", F.xxhash64(F.lit(17), "doc_id", "size")).withColumns({
        "_b1": F.pmod(F.shiftrightunsigned("_h", 58), F.lit(FAN)), "_b2": F.pmod(F.shiftrightunsigned("_h", 52), F.lit(FAN))})
    fine = h.groupBy("source", "_b1", "_b2").agg(F.sum("size").alias("_n"))
    coarse = fine.groupBy("source", "_b1").agg(F.sum("_n").alias("_n"))

    def before(*keys: str) -> Window:
        return Window.partitionBy(*keys)

    up_to = (Window.unboundedPreceding, -1)
    coarse = coarse.select("source", "_b1", F.coalesce(F.sum("_n").over(before("source").orderBy("_b1").rowsBetween(*up_to)), F.lit(0)).alias("_o1"))
    fine = fine.select("source", "_b1", "_b2", F.coalesce(
        F.sum("_n").over(before("source", "_b1").orderBy("_b2").rowsBetween(*up_to)), F.lit(0)).alias("_o2"))
    offsets = fine.alias("f").join(
        coarse.alias("c"), F.col("f.source").eqNullSafe(F.col("c.source")) & (F.col("f._b1") == F.col("c._b1"))
    ).select("f.source", "f._b1", "f._b2", (F.col("c._o1") + F.col("f._o2")).alias("_o"))
    inside = before("source", "_b1", "_b2").orderBy("_h", "doc_id", "size", *carry).rowsBetween(*up_to)
    h = h.withColumn("_i", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return h.alias("h").join(
        offsets.alias("o"),
        F.col("h.source").eqNullSafe(F.col("o.source")) & (F.col("h._b1") == F.col("o._b1")) & (F.col("h._b2") == F.col("o._b2")),
    ).select("h.doc_id", "h.source", "h.size", *[f"h.{c}" for c in carry], (F.col("h._i") + F.col("o._o")).alias("_start"))


def training_positions(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                       curriculum: Sequence[Schedule] = CURRICULUM, row: str | None = None) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text, source``): ``doc_id, size, source, source_size, target, uses``.

    ``uses`` has one entry per time the document is trained on: ``pass`` (0, 1), ``words`` (the document's size;
    less only for the one document per source and pass in which the target is reached) and ``position`` (0 to 1).
    Its words add up to the source's target but for rounding. Null and empty texts have size 0 and no uses;
    null sources are one source, the last; rows with equal ids are documents of their own; an empty table gives
    an empty result; further columns are ignored, but for the one that ``row`` names: unique longs that tell rows apart, returned
    as ``row``. The same rows always give the same positions.
    """
    carry = ["row"] if row else []
    own = [F.col(f"`{row}`").alias("row")] if row else []
    sized = stored(docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), *own), "sizes")
    totals = source_targets(sized, weights, share, most, curriculum)
    rows = _running(sized, carry).alias("r").join(totals.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("r.doc_id", "r.source", "r.size", *[f"r.{c}" for c in carry], "r._start", "t.source_size", "t.target", "t.segments")
    demand = F.round("target").cast("long")
    passes = int(-(-most // 1))
    uses = F.array(*[
        F.struct(
            F.lit(k).alias("pass"),
            F.least(F.greatest(demand - F.col("source_size") * k - F.col("_start"), F.lit(0)), F.col("size")).alias("words"),
            invert(F.col("segments"), (F.col("source_size") * k + F.col("_start")) / F.greatest(demand, F.lit(1))).alias("position"),
        ) for k in range(passes)])
    return rows.select("doc_id", *carry, "size", "source", "source_size", "target", F.filter(uses, lambda x: x["words"] > 0).alias("uses"))


def mix_summary(docs: DataFrame, **how) -> DataFrame:
    """One row per document, range-sorted by first position (unused documents last): words taken and positions."""
    placed = training_positions(docs, **how)
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("uses").cast("long").alias("passes"),
        F.try_element_at("uses", F.lit(1))["position"].alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents in training order, with all their columns, repeated as often as they are used.

    Documents stay whole: the one in which a source's target is reached is used when at least half of its words are wanted.
    Every row is a document of its own, also where ids are shared or null. An empty table gives an empty result.
    """
    rows, row = numbered(docs, "rows")
    uses = training_positions(rows, **how, row=row).select("row", "size", F.explode("uses").alias("use"))
    uses = uses.where(F.col("use.words") * 2 >= F.col("size")).select(F.col("row").alias("used"), F.col("use.position").alias("position"))
    # the columns of docs travel as one, so that theirs may have any names
    whole = rows.select(F.col(row).alias("own"), F.col("doc_id").alias("own_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    placed = whole.join(uses, F.col("own") == F.col("used")).repartitionByRange("position", "own_id", "own")
    placed = placed.sortWithinPartitions("position", "own_id", "own")
    return placed.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
