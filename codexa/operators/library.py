"""Searching, matching and keeping collections: filters, nearest rows, aliases, mirrors and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def approved(rows: DataFrame, status: str = "review_status", passing: Iterable[str] = ("approved", "passed"), unreviewed: bool = False) -> DataFrame:
    """Rows whose review has passed; those without a passing review too, if asked for."""
    return rows if unreviewed else rows.where(F.lower(status).isin(*passing))


def find_documents(docs: DataFrame, author: str | None = None, year_from: int | None = None, year_to: int | None = None, category: str | None = None, title_contains: str | None = None) -> DataFrame:
    """Documents that meet every condition given; years are half-open ranges of ``published``, texts ignore case."""
    tests: list[Column] = []
    if author:
        tests.append(F.exists("authors", lambda a: F.contains(F.lower(a), F.lit(author.lower()))))
    if year_from:
        tests.append(F.col("published") >= F.make_date(F.lit(year_from), F.lit(1), F.lit(1)))
    if year_to:
        tests.append(F.col("published") < F.make_date(F.lit(year_to + 1), F.lit(1), F.lit(1)))
    if category:
        tests.append((F.col("primary_category") == category) | F.array_contains("categories", category))
    if title_contains:
        tests.append(F.col("title").ilike(f"%{title_contains}%"))
    return docs.where(reduce(lambda a, b: a & b, tests)) if tests else docs


def request_kind(question: Column | str) -> Column:
    """Whether a question asks for a list of documents, for certain documents, or for what they say."""
    q = F.lower(_c(question))
    return F.when(q.rlike(r"\b(?:list|how many|which (?:documents|plans|brochures))\b"), "list").when(q.rlike(r"\b(?:find|show me|published|titled|by author)\b"), "find").otherwise("content")


def nearest_to(rows: DataFrame, vector: str, wanted: list[float], key: str, k: int, owner: str | None = None, owners: list | None = None) -> DataFrame:
    """(key, distance): the ``k`` rows nearest to one vector by cosine distance, of certain owners if named.

    Each task keeps its best k, so nothing but those is shuffled. Null vectors, other lengths and zero norms take no part.
    """
    rows = rows.where(F.col(owner).isin(owners)) if owners is not None else rows
    q = F.array(*[F.lit(float(x)) for x in wanted])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    e = F.transform(vector, lambda x: x.cast("double"))
    held = rows.where(F.col(vector).isNotNull() & (F.size(vector) == len(wanted))).select(key, e.alias("e"))
    norm = F.sqrt(dot(F.col("e"), F.col("e")))
    size = sum(x * x for x in wanted) ** 0.5
    out = held.select(key, dot(F.col("e"), q).alias("d"), norm.alias("n")).where((F.col("n") > 0) & ~F.isnan("n"))
    return out.select(key, F.round(1 - F.col("d") / (F.col("n") * size), 9).alias("distance")).orderBy("distance", key).limit(k)


def filter_clusters(clusters: DataFrame, least: int = 2, kinds: list[str] | None = None, owner: str | None = None, one_owner: bool | None = None, text: str | None = None) -> DataFrame:
    """Clusters (size, kinds, owners, title) that meet what is given: size, any of the kinds, an owner, one or several owners, words in the title."""
    tests = [F.col("size") >= least]
    if kinds:
        tests.append(F.arrays_overlap("kinds", F.array(*map(F.lit, kinds))))
    if owner:
        tests.append(F.array_contains("owners", owner))
    if one_owner is not None:
        tests.append((F.size("owners") == 1) if one_owner else (F.size("owners") > 1))
    if text:
        tests.append(F.contains(F.lower("title"), F.lit(text.lower())))
    return clusters.where(reduce(lambda a, b: a & b, tests))


def best_alias(rows: DataFrame, key: str, text: str, aliases: list[tuple[str, str]], concepts: list[tuple[str, list[list[str]]]]) -> DataFrame:
    """(key, name, score): the most specific name a text stands for.

    An alias that stands in the text as a phrase scores 1000 and its words; a name whose groups of concept words are
    all met scores 500 and the words of the longest phrase met in each. Ties go to the smaller name.
    """
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))
    has = lambda p: F.col("_t").contains(f" {p} ")
    hits = [F.when(has(a), F.struct(F.lit(1000 + len(a.split())).alias("score"), F.lit(n).alias("name"))) for a, n in aliases]
    for name, groups in concepts:
        best = [F.coalesce(F.greatest(*[F.when(has(p), len(p.split())).otherwise(0) for p in g], F.lit(0)), F.lit(0)) for g in groups]
        met = reduce(lambda a, b: a & b, [x > 0 for x in best])
        hits.append(F.when(met, F.struct((500 + reduce(lambda a, b: a + b, best)).alias("score"), F.lit(name).alias("name"))))
    flat = rows.select(key, norm.alias("_t")).select(key, F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return flat.groupBy(key).agg(F.min_by("h", F.struct(-F.col("h.score"), "h.name")).alias("h")).select(key, "h.name", "h.score")


def top_ranked(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each key all rows that share the first place."""
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def staged(lists: list[DataFrame], keys: list[str], dedup: list[str], rank: str, k: int) -> DataFrame:
    """Several ranked lists, each after the one before it; a row counts once, where it comes first; the first ``k`` of each key."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.withColumn("stage", F.lit(i)) for i, df in enumerate(lists)])
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, *dedup).orderBy("stage", rank))).where("_r = 1").drop("_r")
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("stage", rank, *dedup))).where(F.col("place") <= k)


def mirrored(source: DataFrame, mirror: DataFrame, key: str, digest: Column) -> DataFrame:
    """(key, action): what brings a mirror up to its source: insert, update, delete; rows alike aren't named."""
    a, b = source.select(key, digest.alias("_a"), F.lit(True).alias("_in")), mirror.select(key, digest.alias("_b"), F.lit(True).alias("_there"))
    j = a.join(b, key, "full_outer")
    action = F.when(F.col("_there").isNull(), "insert").when(F.col("_in").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
    return j.select(key, action.alias("action")).where("action IS NOT NULL")


def not_cached(rows: DataFrame, cache: DataFrame, *digests: str) -> DataFrame:
    """Rows whose content, by its hashes, hasn't been processed; null hashes never have."""
    return rows.join(cache.select(*digests).distinct(), list(digests), "left_anti")


def with_surrogate_key(rows: DataFrame, out: str, *natural: str) -> DataFrame:
    """A key that follows from the natural one, so that parents can be written again and children found without asking."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural])
    return rows.withColumn(out, F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"))


def header_runs(tables: DataFrame, key: str, page: str, headers: str, default: str = r"^(?:column|unnamed)_?\d*$") -> DataFrame:
    """Tables with ``headers``: those without headers of their own take the ones of the page before, page by page, while pages follow and widths agree."""
    w = Window.partitionBy(key).orderBy(page)
    plain = F.forall(headers, lambda h: F.lower(h).rlike(default))
    prev = F.lag(F.struct(F.col(page).alias("p"), F.size(headers).alias("n"))).over(w)
    follows = plain & (F.col(page) == prev.p + 1) & (F.size(headers) == prev.n)
    t = tables.withColumn("_f", F.coalesce(follows, F.lit(False)))
    t = t.withColumn("_run", F.sum((~F.col("_f")).cast("int")).over(w))
    return t.withColumn("shown", F.first(headers).over(Window.partitionBy(key, "_run").orderBy(page))).drop("_f", "_run")


def split_merged(rows: DataFrame, key: str, text: str, name: str, amount: str) -> DataFrame:
    """(key, place, name, amount): rows that ran into one cell, taken apart where it holds as many names as amounts."""
    n, a = F.regexp_extract_all(text, F.lit(name), F.lit(0)), F.regexp_extract_all(text, F.lit(amount), F.lit(0))
    t = rows.select(key, n.alias("n"), a.alias("a")).where((F.size("n") > 1) & (F.size("n") == F.size("a")))
    return t.select(key, F.posexplode(F.arrays_zip("n", "a")).alias("place", "x")).select(key, "place", F.col("x.n").alias("name"), F.col("x.a").alias("amount"))


def page_cuts(ink: DataFrame, key: str, row: str, share: str, blank: float = 0.002, least_gap: int = 3, rule: float = 0.35) -> DataFrame:
    """(key, cut, kind): where a page can be cut, by the share of ink in each of its rows: middles of gaps, and ruled lines.

    A page's rows are bounded by its height, so each page is one small window.
    """
    kind = F.when(F.col(share) >= rule, "rule").when(F.col(share) <= blank, "gap")
    w = Window.partitionBy(key).orderBy(row)
    t = ink.select(key, row, kind.alias("kind"))
    t = t.withColumn("run", F.sum((~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | (F.col(row) != F.lag(row).over(w) + 1)).cast("int")).over(w))
    runs = t.where("kind IS NOT NULL").groupBy(key, "run", "kind").agg(F.min(row).alias("a"), F.max(row).alias("b"))
    return runs.where((F.col("kind") == "rule") | (F.col("b") - F.col("a") + 1 >= least_gap)).select(key, F.floor((F.col("a") + F.col("b")) / 2).alias("cut"), "kind")


def resolved(reviewed: DataFrame, candidates: DataFrame, key: str, version: str, allow_candidate: bool = True) -> DataFrame:
    """(key, version, origin): the greatest reviewed version, else the greatest candidate where candidates are allowed, else null."""
    a = reviewed.groupBy(key).agg(F.max(version).alias("_r"))
    b = candidates.groupBy(key).agg(F.max(version).alias("_c"))
    c = F.col("_c") if allow_candidate else F.lit(None).cast("string")
    out = F.coalesce("_r", c)
    return a.join(b, key, "full_outer").select(key, out.alias("version"), F.when(F.col("_r").isNotNull(), "reviewed").when(out.isNotNull(), "candidate").alias("origin"))


def corrective_search(question: DataFrame, search: Callable, grade: Callable, rewrite: Callable, answer: Callable, supported: Callable, rewrites: int = 1, attempts: int = 2) -> dict:
    """Retrieve, grade, rewrite at most so often, answer and check at most so often; the steps are given as functions.

    ``search(questions)`` gives rows, ``grade(rows)`` whether they are good enough, ``rewrite(questions)`` new
    questions, ``answer(rows)`` a text and ``supported(text, rows)`` whether the rows bear it out.
    """
    done = 0
    rows = search(question)
    while not grade(rows) and done < rewrites:
        question, done = rewrite(question), done + 1
        rows = search(question)
    if not grade(rows):
        return {"answer": None, "rewrites": done, "attempts": 0, "rows": rows}
    for n in range(1, attempts + 1):
        text = answer(rows)
        if supported(text, rows):
            return {"answer": text, "rewrites": done, "attempts": n, "rows": rows}
    return {"answer": None, "rewrites": done, "attempts": attempts, "rows": rows}
