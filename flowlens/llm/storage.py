"""Intermediate tables on the folder that the whole cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import shared_dir

#: What separates words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage and survives the loss of any executor. An empty table comes back empty
    with the same columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` stored with one more column of unique longs, and that column's name, which no column of ``df`` has.

    It tells apart rows that share an id, have none, or are equal. Written once, so a retried task cannot number anew; as it
    is a copy of all texts, it is packed more tightly than other tables.
    """
    taken, row = {c.lower() for c in df.columns}, "row_number"
    while row in taken:
        row = f"_{row}"
    return stored(df.withColumn(row, F.monotonically_increasing_id()), name, compression="zstd"), row


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can never clash with working names."""
    return df.select(*[F.col(f"`{n}`") for n in names])
