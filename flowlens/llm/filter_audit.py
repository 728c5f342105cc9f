"""How five filters of a corpus interact, kept up incrementally over a stream of document files.

All files pass as available-now micro-batches of a file stream. Each document becomes a mask of the filters it fails:
A to D by its text alone, E (a copy of a smaller id) by the smallest id known for its text. That id is the state, one row
per distinct text. When a smaller id arrives in a later batch, the document that held the place fails E after all: its
earlier mask is retracted from the counters of its part and the mask with E is added.

Counters say how many documents of a part fail exactly a set of filters (32 sets), split by labels. Everything asked about
any order of the filters follows from them, so no document is looked at once per order.

A batch writes its own folders under its batch id and reads only the state of the batch before it, so a batch that runs
again after a failure replaces its own output; a stream that is started again goes on. Texts never leave the scan: they are
known by 128 bits of SHA-256. Rows that are alike are folded before every shuffle by text, and a text with any share of all
documents brings one row per batch to its state. The number of batches is a parameter (``batches``), so the state is
rewritten a fixed number of times, whatever the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm.storage import columns_of, stored
from flowlens.session import fresh_path

# The filters, their bits in a mask, and their limits.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # of 100 words
MOST_CAPITALS = 5  # of 100 code points
SIGNS = "[#$%&*|]"
GAPS = r"[\x20\x09-\x0D]+"

COPY = 1 << FILTERS.index("E")
SETS = 1 << len(FILTERS)
SALTS = 8
BATCHES = 6

_KEY = ["hi", "lo"]
_SIGNATURE = ["part", "mask", "good", "toxic"]


def judge(docs: DataFrame) -> DataFrame:
    """``hi, lo, doc_id, part, mask``: each row's text as a digest, and the filters A to D that it fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = columns_of(docs, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumns({
        "words": F.filter(F.split("text", GAPS), lambda w: w != ""), "sha": F.sha2("text", 256), "chars": F.length("text"),
        "capitals": F.length(F.regexp_replace("text", "[^A-Z]+", "")), "signs": F.col("text").rlike(SIGNS)})
    rows = rows.select(
        "doc_id", "part", "sha", "chars", "capitals", "signs", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"))
    fails = [F.col("n") < LEAST_WORDS, 100 * F.col("distinct").cast("long") < LEAST_DISTINCT * F.col("n").cast("long"),
             100 * F.col("capitals").cast("long") > MOST_CAPITALS * F.col("chars").cast("long"), F.col("signs")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    half = [F.conv(F.substring("sha", at, 16), 16, -10).cast("long").alias(c) for c, at in (("hi", 1), ("lo", 17))]
    return rows.select(*half, "doc_id", "part", mask.alias("mask"))


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, salt, good, toxic``: one row per labelled id and salt; any label of 1 counts."""
    def one(c: str) -> Column:
        return F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias({"quality": "good"}.get(c, c))

    per = columns_of(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")).where("good + toxic > 0")
    return per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


@dataclass
class FilterAudit:
    """Folder with the state and the counters of one audit, and the progress of its stream."""

    path: str
    labels: DataFrame  # as from known_labels

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """Take one micro-batch in; fits ``foreachBatch``."""
        spark = batch.sparkSession
        alike = judge(batch).groupBy(*_KEY, "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
        # salted: an id, or none, may be shared by any number of texts
        alike = alike.withColumn("salt", F.pmod(F.xxhash64(*_KEY), F.lit(SALTS)).cast("int")).join(self.labels, ["doc_id", "salt"], "left")
        alike = alike.drop("salt").fillna(0, ["good", "toxic"])
        alike.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
        rows = spark.read.schema(alike.schema).parquet(f"{self.path}/rows/batch={batch_id}")

        # all rows with an id enter as copies; the first of each text is then promoted
        entered = rows.withColumn("mask", F.when(F.col("doc_id").isNull(), F.col("mask")).otherwise(F.col("mask").bitwiseOR(COPY)))
        least = rows.groupBy(*_KEY).agg(F.min("doc_id").alias("doc_id"))
        fresh = rows.join(least, [*_KEY, "doc_id"]).withColumn("fresh", F.lit(True))
        held = fresh
        if batch_id > 0:
            before = spark.read.schema(self._state_schema(fresh)).parquet(f"{self.path}/state/batch={batch_id - 1}").where("first")
            before = before.groupBy(*_KEY, "doc_id", *_SIGNATURE).agg(F.sum("n").alias("n")).withColumn("fresh", F.lit(False))
            held = fresh.unionByName(before.select(*fresh.columns))
        # per text the rows of at most two ids: the smallest so far, and the smallest of this batch
        held = held.withColumn("first", F.col("doc_id") == F.min("doc_id").over(Window.partitionBy(*_KEY)))
        held.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
        held = spark.read.schema(held.schema).parquet(f"{self.path}/state/batch={batch_id}")

        def moved(which: Column, taken: Column, given: Column) -> DataFrame:
            some = held.where(which)
            return some.select("part", taken.alias("mask"), "good", "toxic", (-F.col("n")).alias("n")).unionByName(
                some.select("part", given.alias("mask"), "good", "toxic", "n"))

        copy, alone = F.col("mask").bitwiseOR(COPY), F.col("mask")
        promoted = moved(F.col("fresh") & F.col("first"), copy, alone)
        retracted = moved(~F.col("fresh") & ~F.col("first"), alone, copy)
        changes = entered.select(*_SIGNATURE, "n").unionByName(promoted).unionByName(retracted)
        changes.groupBy(*_SIGNATURE).agg(F.sum("n").alias("n")).where("n <> 0").write.mode("overwrite").parquet(
            f"{self.path}/counters/batch={batch_id}")
        self._forget(spark, batch_id - 2)

    def _state_schema(self, fresh: DataFrame):
        return fresh.withColumn("first", F.lit(True)).schema

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Remove what belongs to a batch that can no longer run again, its counters excepted."""
        jvm = spark.sparkContext._jvm
        for name in ("rows", "state"):
            old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/batch={batch_id}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    def run_available(self, stream: DataFrame) -> None:
        """Process all files that are new; a further run goes on from there."""
        q = stream.writeStream.trigger(availableNow=True).option(
            "checkpointLocation", f"{self.path}/progress").foreachBatch(self.update).start()
        q.awaitTermination()

    def counters(self, spark: SparkSession) -> DataFrame:
        """``part, mask, good, toxic, n``: documents that fail exactly the filters of ``mask``."""
        jvm = spark.sparkContext._jvm
        made = jvm.org.apache.hadoop.fs.Path(f"{self.path}/counters")
        schema = "part string, mask int, good int, toxic int, n long"
        if not made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(made):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.path}/counters/*").groupBy(*_SIGNATURE).agg(F.sum("n").alias("n")).where("n <> 0")


def interactions(counters: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from the counters.

    With U(S) the documents that fail none of S, a filter f after the set S removes U(S) - U(S + f); its removals over all
    orders weigh each S by the number of orders in which exactly S comes before f.
    """
    def passing(s: int, weight: Column) -> Column:
        return F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, weight).otherwise(F.lit(0).cast("long")))

    n = F.col("n")
    weights = {"all": n, "good": n * F.col("good"), "toxic": n * F.col("toxic")}
    exactly = [F.sum(F.when(F.col("mask") == 1 << i, n).otherwise(F.lit(0).cast("long"))) for i in range(len(FILTERS))]
    per = counters.groupBy("part").agg(
        *[F.array(*[passing(s, w) for s in range(SETS)]).alias(f"u_{k}") for k, w in weights.items()], F.array(*exactly).alias("alone"))

    def over_orders(i: int) -> Column:
        total = F.lit(0).cast("long")
        for s in range(SETS):
            if not s >> i & 1:
                before = s.bit_count()
                total = total + factorial(before) * factorial(len(FILTERS) - 1 - before) * (F.col("u_all")[s] - F.col("u_all")[s | 1 << i])
        return total

    per = per.withColumn("over_orders", F.array(*[over_orders(i) for i in range(len(FILTERS))]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = per.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def place(at: Column | int) -> Column:
        return F.instr(F.lit(FILTERS), F.substring("filter_order", at, 1)) - 1

    before = sum((F.when(F.col("step") > j, F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), place(j) + 1)).otherwise(0)
                  for j in range(1, len(FILTERS))), F.lit(0))
    rows = rows.withColumns({"before": before, "i": place(F.col("step"))})
    rows = rows.withColumn("after", F.col("before") + F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("i") + 1))
    bit = F.col("after") - F.col("before")

    def u(kind: str, s: Column) -> Column:
        return F.element_at(f"u_{kind}", s + 1)

    removed = u("all", F.col("before")) - u("all", F.col("after"))
    return rows.select(
        "part", "filter_order", "step", u("all", F.col("after")).alias("kept"), removed.alias("removed"),
        (u("all", F.lit(0)) - u("all", bit) - removed).alias("redundant"), F.element_at("alone", F.col("i") + 1).alias("unique_fails"),
        *[(u(k, F.col("before")) - u(k, F.col("after"))).alias(f"{k}_lost") for k in ("good", "toxic")],
        F.element_at("over_orders", F.col("i") + 1).alias("shapley"))


def _as_stream_path(spark: SparkSession, path: str) -> str:
    """A file stream reads folders; a single file is named by a pattern that only it matches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where)
    return f"{path[:-1]}[{path[-1]}]" if status.isFile() else path


def audit_filters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Stream the Parquet files of ``path`` (``doc_id, text, source``; other columns are not read) through the audit.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``, 600 rows per
    part. Null texts are empty, a null source is the part ''. Rows without an id are compared with nothing: they never fail
    E and make no other row fail it. Rows with the same id and text are no copies of each other; each counts. An id with
    several labels counts as good or toxic where any of them is 1. An empty table has no parts, so no rows.
    """
    table = spark.read.parquet(path)
    # paths only; the files themselves are read by the stream
    each = max(1, -(-len(table.inputFiles()) // batches))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(_as_stream_path(spark, path))
    audit = FilterAudit(fresh_path(spark, "filter_audit"), stored(known_labels(labels), "labels"))
    audit.run_available(stream.select("doc_id", "text", "source"))
    return interactions(audit.counters(spark))
