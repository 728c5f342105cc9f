"""Readers for raw flow files, canonical tables and replay files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions.exprs import snake

INT_COLUMNS = {"Src Port", "Dst Port", "Protocol", "Attempted Category"}
TEXT_COLUMNS = {"id", "Flow ID", "Src IP", "Dst IP", "Label"}
META_NAMES = {
    "Src IP": "src_ip", "Src Port": "src_port", "Dst IP": "dst_ip", "Dst Port": "dst_port",
    "Protocol": "protocol", "Timestamp": "ts", "Label": "label", "Attempted Category": "attempted_category",
}
SKIPPED = ["id", "Flow ID"]
FLOW_FEATURES = [c for c in K.FLOW_CSV_COLUMNS if c not in META_NAMES and c not in SKIPPED]

REPLAY_META = (
    "flow_id string, observed_at timestamp, t_rel_s double, src_ip string, src_port int, dst_ip string, "
    "dst_port int, protocol int, ground_truth string, tool string"
)


def flow_csv_schema() -> str:
    """The 91 pinned columns with their types, in file order."""
    def kind(c: str) -> str:
        if c in TEXT_COLUMNS:
            return "string"
        return "int" if c in INT_COLUMNS else "timestamp" if c == "Timestamp" else "double"
    return ", ".join(f"`{c}` {kind(c)}" for c in K.FLOW_CSV_COLUMNS)


def honeypot_csv_schema() -> str:
    return ", ".join(f"{c} {kind}" for c, kind in K.HONEYPOT_CSV_TYPES.items())


def read_flow_csv(spark: SparkSession, path: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Raw flow CSV with a pinned header.

    ``strict`` fails on a changed header or an unparsable value; otherwise bad values become null.
    """
    df = (
        spark.read.schema(flow_csv_schema()).option("header", True).option("enforceSchema", not strict)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("positiveInf", "Infinity").option("negativeInf", "-Infinity").option("nanValue", "NaN")
        .csv(path)
    )
    return df.select(*[F.col(f"`{c}`").alias(META_NAMES.get(c, snake(c))) for c in K.FLOW_CSV_COLUMNS if c not in SKIPPED])


def read_honeypot_csv(spark: SparkSession, path: str | Sequence[str], strict: bool = True) -> DataFrame:
    """Daily honeypot CSV: 16 pinned columns plus ``day`` from the yyyy.MM.dd in the file's path."""
    df = (
        spark.read.schema(honeypot_csv_schema()).option("header", True).option("enforceSchema", not strict)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    )
    stamp = F.regexp_extract(F.col("_metadata.file_path"), r".*(\d{4}\.\d{2}\.\d{2})", 1)
    return df.select(*K.HONEYPOT_CSV_TYPES, F.to_date(stamp, "yyyy.MM.dd").alias("day"))


def write_canonical(df: DataFrame, path: str, day: str = "day") -> None:
    """Parquet (zstd), one directory per day.

    Rows are rebalanced by day: adaptive execution splits a day that owns most rows over
    several tasks and files, and merges small days into one task.
    """
    df.hint("rebalance", day).write.mode("overwrite").partitionBy(day).option("compression", "zstd").parquet(path)


def scan_flows(
    spark: SparkSession, path: str, days: Sequence | None = None, tools: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read only the wanted days, tools and columns; days prune directories, tools reach the file filter."""
    df = spark.read.parquet(path)
    if days is not None:
        df = df.where(F.col("day").isin(list(days)))
    if tools is not None:
        df = df.where(F.col("tool").isin(list(tools)))
    return df.select(*columns) if columns is not None else df


def replay_schema(features: Sequence[str]) -> str:
    return REPLAY_META + "".join(f", {f} float" for f in features if f != "protocol")


def read_replay(spark: SparkSession, path: str, features: Sequence[str]) -> DataFrame:
    """Replay CSV (gzip too): meta columns and features; ports are held at 0 or above."""
    df = spark.read.schema(replay_schema(features)).option("header", True).csv(path)
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("src_port", "dst_port")})


def stream_replay(spark: SparkSession, path: str, features: Sequence[str], files_per_trigger: int = 1) -> DataFrame:
    """The same files as a stream."""
    df = (
        spark.readStream.schema(replay_schema(features)).option("header", True)
        .option("maxFilesPerTrigger", files_per_trigger).csv(path)
    )
    return df.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in ("src_port", "dst_port")})
