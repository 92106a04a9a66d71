"""Connected components over edges, by alternating star steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Uses the session's spark.checkpoint.dir; sets one of its own only where none is set on a local master, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def kept(df: DataFrame) -> DataFrame:
    """Checkpointed; the shuffle files behind it are deleted at once, not when the driver next collects its garbage."""
    out = df.checkpoint()
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node is linked with.

    Each round turns the edges into stars around ever smaller nodes; a hot node
    is only ever aggregated and joined, never gathered. Null ends and loops are
    left out; no edges give no rows.
    """
    ensure_checkpoint_dir(edges)
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = kept(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(floor.select("u", F.col("m").alias("v")))
        new = kept(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).distinct()
