"""Noise, boilerplate and duplicates in chunk collections, without pairwise comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators.graph import connected_components, kept
from codexa.operators.runs import banded, similar
from codexa.sources.tables import few


def chunk_lines(chunks: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line): masked lines of 8 to 120 characters."""
    return chunks.select(*keys, F.explode(F.split(text, "\n", -1)).alias("l")).select(*keys, F.trim("l").alias("l")).where(F.length("l").between(8, 120)).select(*keys, X.masked_line("l").alias("line"))


def boilerplate_lines(chunks: DataFrame, family: str, document: str, text: str = "text", least: int = 5, share: float = 0.1) -> DataFrame:
    """(family, line, docs): lines in at least ``least`` documents and that share of the family's."""
    n = chunks.groupBy(family).agg(F.count_distinct(document).alias("of"))
    df = chunk_lines(chunks, family, document, text=text).distinct().groupBy(family, "line").agg(F.count("*").alias("docs"))
    return df.join(n, family).where(F.col("docs") >= F.greatest(F.lit(float(least)), share * F.col("of"))).select(family, "line", "docs")


def boilerplate_share(chunks: DataFrame, lines: DataFrame, key: str, family: str, text: str = "text") -> DataFrame:
    """(key, share): which part of a chunk's lines that aren't blank are boilerplate."""
    all_lines = chunks.select(key, family, F.explode(F.split(text, "\n", -1)).alias("l")).where(F.trim("l") != "").select(key, family, X.masked_line("l").alias("line"))
    j = all_lines.join(lines.select(family, "line", F.lit(1).alias("hit")), [family, "line"], "left")
    return j.groupBy(key).agg((F.count("hit") / F.count("*")).alias("share"))


def nearest_rank(values: Column, q: float, of: str = "n") -> Column:
    """The element of a sorted array at place int(q * n), or int(q * (n - 1)) for ``n-1``, or ceil(q n) - 1 for ``ceil``; from 0."""
    n = F.size(values)
    at = {"n": F.least(F.floor(q * n), n - 1), "n-1": F.floor(q * (n - 1)), "ceil": F.greatest(F.ceil(q * n) - 1, F.lit(0))}[of]
    return F.when(n > 0, F.element_at(values, (at + 1).cast("int")))


def counted_percentile(df: DataFrame, group: list[str], value: str, q: float, of: str = "n-1") -> DataFrame:
    """(group, value): a nearest-rank percentile from counts per value, so that no group is gathered in one place."""
    c = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*group).orderBy(value)
    n = F.sum("k").over(Window.partitionBy(*group))
    at = {"n": F.least(F.floor(q * n), n - 1), "n-1": F.floor(q * (n - 1)), "ceil": F.greatest(F.ceil(q * n) - 1, F.lit(0))}[of]
    return c.withColumn("upto", F.sum("k").over(w)).withColumn("at", at).where(F.col("upto") > F.col("at")).groupBy(*group).agg(F.min(value).alias("value"))


def concentration(counts: DataFrame, ks: list[int]) -> DataFrame:
    """(k, share): which part of all rows the k largest owners hold; ``counts`` has one row an owner, column n."""
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n")).limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"))))
    cut = counts.sparkSession.createDataFrame([(k,) for k in ks], "k int")
    got = top.join(F.broadcast(cut), F.col("r") <= F.col("k")).groupBy("k").agg(F.sum("n").alias("held"))
    return got.crossJoin(F.broadcast(total)).select("k", F.round(F.col("held") / F.col("total"), 6).alias("share"))  # total is one row


def exact_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, representative, copies) of texts that are the same after normalisation; empty texts are left out."""
    norm = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    h = rows.select(key, norm.alias("norm")).where("norm <> ''").select(key, F.sha1("norm").alias("h"))
    g = h.groupBy("h").agg(F.min(key).alias("representative"), F.count("*").alias("copies")).where("copies > 1")
    return h.join(g, "h").select(key, "representative", "copies")


def shingles(tokens: Column, k: int = 3) -> Column:
    """Distinct runs of k tokens; shorter texts have one."""
    n = F.size(tokens)
    width = F.greatest(n - (k - 1), F.lit(0))
    # slices side by side: a lambda that looked into the tokens would compute them anew for each element
    runs = F.slice(tokens, 1, width)
    for j in range(1, k):
        runs = F.zip_with(runs, F.slice(tokens, j + 1, width), lambda x, y: F.concat(x, F.lit(" "), y))
    many = F.array_distinct(runs)
    return F.when(n == 0, F.array().cast("array<string>")).when(n < k, F.array(F.array_join(tokens, " "))).otherwise(many)


def candidate_pairs(rows: DataFrame, key: str, text: str, k: int = 5, permutations: int = 128, hot: int = 500) -> DataFrame:
    """(a, b): distinct pairs that share a band of two minima; keys are bigint.

    A band that more than ``hot`` texts share isn't paired; the similar pairs among its texts are found exactly instead.
    """
    return banded(rows, key, text, k, permutations, hot, lambda warm: similar_pairs(warm, "key", "text", k=k))


def similar_pairs(rows: DataFrame, key: str, text: str, least: float = 0.8, k: int = 5, contained: float = 0.95) -> DataFrame:
    """(a, b, jaccard, containment, kind): near and contained duplicates of distinct texts.

    Exact, over 64-bit hashes of the runs, see ``runs.similar``; keys are bigint. Copies must be collapsed before,
    see ``exact_groups``.
    """
    j = similar(rows, key, text, least, k, contained).select("a", "b", (F.col("c") / (F.col("la") + F.col("lb") - F.col("c"))).alias("jaccard"), (F.col("c") / F.least("la", "lb")).alias("containment"))
    return kept(j.where((F.col("jaccard") >= least) | (F.col("containment") >= contained)).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("containment", 6).alias("containment"), F.when(F.col("jaccard") >= least, "near").otherwise("contained").alias("kind")))


def numbers_differ(pairs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs with ``differs``: figures on one side only; for contained pairs only those of the smaller text count."""
    ends = few(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct().checkpoint())
    n = rows.join(ends, key, "left_semi").select(F.col(key).alias("k"), X.numbers_in(text).alias("nums"), F.length(text).alias("len"))
    a, b = n.select(F.col("k").alias("a"), F.col("nums").alias("na"), F.col("len").alias("la")), n.select(F.col("k").alias("b"), F.col("nums").alias("nb"), F.col("len").alias("lb"))
    only_a, only_b = F.size(F.array_except("na", "nb")) > 0, F.size(F.array_except("nb", "na")) > 0
    differs = F.when(F.col("kind") == "contained", F.when(F.col("la") <= F.col("lb"), only_a).otherwise(only_b)).otherwise(only_a | only_b)
    return pairs.join(a, "a").join(b, "b").select(*pairs.columns, differs.alias("differs"))


def clusters(pairs: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cluster, size, canonical): linked texts; the longest stands for its cluster, ties go to the smaller key."""
    comp = connected_components(pairs, "a", "b")
    c = comp.select(F.col("node").alias(key), F.col("component").alias("cluster")).join(rows.select(key, F.length(text).alias("len")), key)
    w = Window.partitionBy("cluster")
    return c.select(key, "cluster", F.count("*").over(w).alias("size"), (F.row_number().over(w.orderBy(F.desc("len"), key)) == 1).alias("canonical"))
