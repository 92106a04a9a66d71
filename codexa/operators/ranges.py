"""Ordered values along a key whose rows are too many for one task.

A key's rows are parted into ranges of an integer position. Each range is looked
at by itself; what goes over a border is worked out on one row a range and
joined back, so a key with a third of all rows spreads over as many tasks as it
has ranges. Null positions come first; ties are ordered by ``tie``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.operators.graph import ensure_checkpoint_dir

#: Positions in one range.
WIDTH = 512


def _parts(rows: DataFrame, key: str, order: str, tie: str, width: int):
    rows = rows.withColumn("_part", F.floor(F.coalesce(order, F.lit(-1)) / width))
    return rows, Window.partitionBy(key, "_part").orderBy(F.col(order).asc_nulls_first(), tie), Window.partitionBy("_k").orderBy("_p")


def _joined(rows: DataFrame, borders: DataFrame, key: str) -> DataFrame:
    return rows.join(borders, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left").drop("_k", "_p", "_part")


def running_last(rows: DataFrame, key: str, order: str, tie: str, value: Column, out: str, width: int = WIDTH, ahead: bool = False) -> DataFrame:
    """Rows with ``out``: the last value that isn't null at or before them (the first at or after, if ``ahead``)."""
    rows, w, across = _parts(rows.withColumn("_v", value), key, order, tie, width)
    place = F.struct(F.col(order), F.col(tie))
    seen = (F.min_by if ahead else F.max_by)(F.when(F.col("_v").isNotNull(), F.struct("_v")), F.when(F.col("_v").isNotNull(), place))
    borders = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(seen.alias("_s"))
    reach = across.rowsBetween(1, Window.unboundedFollowing) if ahead else across.rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select("_k", "_p", (F.first("_s", True) if ahead else F.last("_s", True)).over(reach).alias("_far"))
    near = F.first("_v", True).over(w.rowsBetween(0, Window.unboundedFollowing)) if ahead else F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_near", near)
    return _joined(rows, borders, key).withColumn(out, F.coalesce("_near", F.col("_far._v"))).drop("_v", "_near", "_far")


def beside(rows: DataFrame, key: str, order: str, tie: str, value: Column, before: str, after: str, width: int = WIDTH) -> DataFrame:
    """Rows with the value of the row before and of the row after."""
    rows, w, across = _parts(rows.withColumn("_v", value), key, order, tie, width)
    place = F.struct(F.col(order), F.col(tie))
    borders = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.max_by(F.struct("_v"), place).alias("_l"), F.min_by(F.struct("_v"), place).alias("_f"))
    borders = borders.select("_k", "_p", F.lag("_l").over(across).alias("_b"), F.lead("_f").over(across).alias("_a"))
    s = F.struct("_v")
    rows = rows.withColumn("_nb", F.lag(s).over(w)).withColumn("_na", F.lead(s).over(w))
    out = _joined(rows, borders, key)
    return out.withColumn(before, F.coalesce("_nb", "_b")["_v"]).withColumn(after, F.coalesce("_na", "_a")["_v"]).drop("_v", "_nb", "_na", "_b", "_a")


def running_sum(rows: DataFrame, key: str, order: str, tie: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Rows with the sum of the values up to and with them."""
    rows, w, across = _parts(rows.withColumn("_v", value), key, order, tie, width)
    borders = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.sum("_v").alias("_s"))
    borders = borders.select("_k", "_p", F.coalesce(F.sum("_s").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_near", F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return _joined(rows, borders, key).withColumn(out, F.col("_near") + F.col("_base")).drop("_v", "_near", "_base")


def numbered(rows: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows with their place from 1 in the order of all of them, which must leave no ties.

    Rows are dealt out by ranges of the order and counted within each; only the ranges' sizes meet in one place.
    """
    ensure_checkpoint_dir(rows)
    held = rows.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()  # places hang on the partitions, which must stay
    held = held.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = held.groupBy("_p").agg(F.count("*").alias("n"))
    base = sizes.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row a partition
    return held.join(F.broadcast(base), "_p").withColumn(out, F.col("_base") + F.col("_i") + 1).drop("_p", "_i", "_base")
