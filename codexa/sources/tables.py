"""Tables by name in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Inputs of more partitions than this (each of at most spark.sql.files.maxPartitionBytes) are never dealt out anew.
FEW = 64


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where small files give fewer partitions than that; larger inputs stay as they are read."""
    wanted, given = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(wanted) if given < min(wanted, FEW) else df


#: A side of a join is broadcast up to this many rows of two or three short columns; beyond, both sides are shuffled.
BROADCAST_ROWS = 400_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast if its rows were counted to be few; otherwise left to an ordinary join. It is counted first: give what is kept."""
    return F.broadcast(df) if df.count() <= most else df
