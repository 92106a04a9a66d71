"""Joins and rewrites that Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the greatest by ``order``; no sort, only an aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Left rows with the right side's last value at or before their time; null if there is none.

    Both sides go through one shuffle and one sort, as a union with a running last value.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, time, value, F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last(F.when(F.col("_side") == 0, F.col(value)), True).over(w)).where("_side = 1").drop("_side")


def range_lookup(rows: DataFrame, at: str, ranges: DataFrame, value: str, width: int) -> DataFrame:
    """Rows with the value of the range [lo, hi] they fall into, null outside; ranges don't overlap.

    Ranges are spread over buckets of ``width``, so that the join has an equality to work with.
    """
    spread = ranges.select("lo", "hi", value, F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("_b"))
    cond = (F.floor(F.col(at) / width) == F.col("_b")) & F.col(at).between(F.col("lo"), F.col("hi"))
    return rows.join(spread, cond, "left").drop("lo", "hi", "_b")


def longest_alias(rows: DataFrame, key: str, text: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """(key, alias, name): the longest alias whose words stand in the text; the list is a stated, small one."""
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    ordered = sorted(aliases, key=lambda a: (-len(a[0]), a[0]))
    pick = F.coalesce(*[F.when(F.col("_t").contains(f" {a} "), F.struct(F.lit(a).alias("alias"), F.lit(n).alias("name"))) for a, n in ordered])
    return rows.select(key, norm.alias("_t")).select(key, pick.alias("m")).where("m IS NOT NULL").select(key, "m.alias", "m.name")


def fuzzy_match(rows: DataFrame, key: str, text: str, block: str, least: float) -> DataFrame:
    """(key, other, share): the row of the same block that holds most of a text's words, from a share on.

    A row that holds so many of a text's words holds one of its rarest ones too, so many of them as the share lets
    miss and one more; rows meet by those only, and whole sets of words are compared after that.
    """
    w = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("a"), F.col(block).alias("k"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    flat = w.select("a", "k", F.size("w").alias("n"), F.explode("w").alias("t"))
    often = flat.groupBy("k", "t").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("a").orderBy("df", "t")
    head = flat.join(often.where("df > 1"), ["k", "t"]).withColumn("i", F.row_number().over(rare))
    # words of no other row use up the rarest places
    alone = head.groupBy("a").agg((F.first("n") - F.count("*")).alias("alone"))
    head = head.join(alone, "a").where(F.col("i") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    met = head.select("a", "k", "t").join(flat.select(F.col("a").alias("other"), "k", "t"), ["k", "t"]).where("a <> other").select("a", "other").distinct()
    both = met.join(w.select("a", F.col("w").alias("x")), "a").join(w.select(F.col("a").alias("other"), F.col("w").alias("y")), "other")
    s = both.select("a", "other", (F.size(F.array_intersect("x", "y")) / F.size("x")).alias("s")).where(F.col("s") >= least)
    return s.groupBy("a").agg(F.min_by("other", F.struct(-F.round("s", 6), "other")).alias("other"), F.round(F.max("s"), 6).alias("share")).withColumnRenamed("a", key)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows overlaid with new ones; a null in a new row keeps the stored value."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest])
    return old.join(n, keys, "full_outer").select(*keys, *[F.coalesce(f"_n_{c}", c).alias(c) for c in rest])
