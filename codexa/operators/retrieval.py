"""Lexical and vector retrieval, fusion and ranking metrics over DataFrames.

Ranks start at 1; ties in score go to the smaller key, after rounding to six
digits so that the order of summation doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import text as X

#: Query vectors that are sent to the executors at once.
QUERY_BLOCK = 4096


def postings(docs: DataFrame, key: str, tokens: Column, asked: DataFrame | None = None) -> DataFrame:
    """(key, term, tf): the inverted index; write it partitioned by term to look terms up without a scan.

    Where the terms ``asked`` are given, others are dropped before anything is shuffled.
    """
    flat = docs.select(key, F.explode(tokens).alias("term"))
    if asked is not None:
        flat = flat.join(counted_broadcast(asked.select("term").distinct()), "term", "left_semi")
    return flat.groupBy(key, "term").agg(F.count("*").alias("tf"))


def counted_broadcast(df: DataFrame, most: int = 500_000) -> DataFrame:
    """Broadcast if its rows (of one or two short columns) were counted to be few; otherwise left to an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def query_terms(queries: DataFrame, qid: str, tokens: Column, distinct: bool = False) -> DataFrame:
    """(qid, term, qtf): a query's terms; repeated ones count once if ``distinct``."""
    n = F.max(F.lit(1).cast("bigint")) if distinct else F.count("*")
    return queries.select(qid, F.explode(tokens).alias("term")).groupBy(qid, "term").agg(n.alias("qtf"))


def bm25(index: DataFrame, lengths: DataFrame, terms: DataFrame, key: str, qid: str, k1: float = 1.5, b: float = 0.75, idf: str = "plus", epsilon: float = 0.25, least_average: float = 0.0) -> DataFrame:
    """(qid, key, score) of rows that share a term with the query.

    ``lengths`` holds (key, dl) of all documents; number and average come from it. ``idf`` is ``plus``,
    ln(1 + (N - df + 0.5) / (df + 0.5)), or ``okapi``, without the 1 and with negative values replaced by
    ``epsilon`` times the average. Index rows of terms nobody asked for are dropped before any shuffle of scores.
    """
    stats = lengths.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("dl"), F.lit(float(least_average))).alias("avg_dl"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    if idf == "okapi":
        raw = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weights = df.crossJoin(F.broadcast(stats)).withColumn("raw", raw)  # stats are one row
        mean = weights.agg((F.avg("raw") * epsilon).alias("floor"))
        weights = weights.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw"))).select("term", "idf")
    else:
        weights = df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = terms.join(weights, "term")
    hits = index.join(asked, "term").join(lengths, key).crossJoin(F.broadcast(stats.select("avg_dl")))
    one = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return hits.groupBy(qid, key).agg(F.sum(one).alias("score"))


class Questions:
    """A block of queries as a matrix of term weights."""

    def __init__(self, rows: list[tuple]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.place: dict[str, int] = {}
        for _, terms, _ in rows:
            for t in terms:
                self.place.setdefault(t, len(self.place))
        self.weights = np.zeros((len(self.place), len(rows)))
        for n, (_, terms, w) in enumerate(rows):
            for t, x in zip(terms, w):
                self.weights[self.place[t], n] += x


def question_blocks(terms: DataFrame, qid: str, weight: str, most: int = 4_000_000) -> Iterator[Questions]:
    """Queries (qid, term, weight) in blocks whose matrix has about ``most`` entries at the most."""
    block: list[tuple] = []
    names: set[str] = set()
    for r in terms.groupBy(F.col(qid).cast("bigint").alias("q")).agg(F.collect_list(F.struct("term", F.col(weight).cast("double").alias("w"))).alias("x")).toLocalIterator():
        names.update(t for t, _ in r.x)
        block.append((r.q, [t for t, _ in r.x], [w for _, w in r.x]))
        if len(block) * len(names) >= most:
            yield Questions(block)
            block, names = [], set()
    if block:
        yield Questions(block)


def top_matches(rows: DataFrame, key: str, blocks: Iterator[Questions], qid: str, k: int, weigh) -> DataFrame:
    """(qid, key, score): the ``k`` best rows of each query by the sum of products of term weights, positive ones only.

    ``weigh(batch, place)`` gives (row number, term number, weight) arrays of a batch of ``rows``, ``place`` being the
    number of each term asked for. Each task keeps the best k of its rows, so little is shuffled however many rows
    share a word with a query; ties go to the smaller key after rounding to six digits.
    """
    spark, schema, out = rows.sparkSession, f"{qid} bigint, {key} bigint, score double", None

    def one(block: Questions) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            q = sent.value
            best_s, best_k = np.zeros((len(q.ids), 0)), np.zeros((len(q.ids), 0), np.int64)
            step = max(1, 2_000_000 // max(len(q.place), len(q.ids), 1))
            for b in batches:
                for s in range(0, len(b), step):
                    part = b.iloc[s : s + step]
                    i, j, w = weigh(part, q.place)
                    held = np.zeros((len(part), len(q.place)))
                    np.add.at(held, (i, j), w)
                    score = np.concatenate([best_s, (held @ q.weights).T], 1)
                    keys = np.concatenate([best_k, np.broadcast_to(part[key].to_numpy(np.int64), (len(q.ids), len(part)))], 1)
                    order = np.lexsort((keys, -np.round(score, 6)), axis=1)[:, :k]
                    best_s, best_k = np.take_along_axis(score, order, 1), np.take_along_axis(keys, order, 1)
            ok = best_s > 0
            yield pd.DataFrame({qid: np.repeat(q.ids, ok.sum(1)), key: best_k[ok], "score": best_s[ok]})

        return rows.mapInPandas(search, schema)

    for block in blocks:
        out = one(block) if out is None else out.unionAll(one(block))
    return spark.createDataFrame([], schema) if out is None else out


def bm25_top(docs: DataFrame, key: str, tokens: Column, length: Column, terms: DataFrame, qid: str, k: int, k1: float = 1.5, b: float = 0.75, least_average: float = 0.0) -> DataFrame:
    """(qid, key, score, rank): the ``k`` best rows by BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    The same scores as ``bm25``, without a row for every query and row that share a word: rows stay where they are.
    """
    held = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), tokens.alias("_t"), length.cast("double").alias("_dl"))
    n_docs, average = docs.agg(F.count("*"), F.avg(length)).first()
    average = max(average or 0.0, least_average) or 1.0
    asked = terms.select("term").distinct()
    df = held.select(F.explode(F.array_distinct("_t")).alias("term")).join(counted_broadcast(asked), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weights = terms.join(df, "term").select(qid, "term", (F.col("qtf") * F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))

    def weigh(part: pd.DataFrame, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, term, tf = [], [], []
        for n, t in enumerate(part["_t"]):
            if t is None:
                continue
            at = [x for x in map(place.get, t) if x is not None]
            if at:
                j, c = np.unique(np.array(at), return_counts=True)
                row.append(np.full(len(j), n))
                term.append(j)
                tf.append(c)
        if not row:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        i, j, c = map(np.concatenate, (row, term, tf))
        return i, j, c * (k1 + 1) / (c + k1 * (1 - b + b * part["_dl"].to_numpy()[i] / average))

    return ranked(top_matches(held, key, question_blocks(weights, qid, "w"), qid, k, weigh), qid, key, k)


def ranked(scores: DataFrame, qid: str, key: str, k: int | None = None, score: str = "score") -> DataFrame:
    """Scores rounded to six digits, with their rank; the best ``k`` of each query."""
    w = Window.partitionBy(qid).orderBy(F.desc("r"), key)
    out = scores.withColumn("r", F.round(score, 6)).withColumn("rank", F.row_number().over(w).cast("bigint"))
    out = out.where(F.col("rank") <= k) if k else out
    return out.select(qid, key, F.col("r").alias("score"), "rank")


def tfidf(docs: DataFrame, queries: DataFrame, key: str, qid: str, doc_text: str, query_text: str, k: int) -> DataFrame:
    """(qid, key, score): the ``k`` best rows by the cosine of word and word-pair vectors, 1 + ln tf, smooth idf, unit length.

    Words and pairs are known by a 64-bit hash, which is what is shuffled in their place.
    """

    def both(t: Column) -> Column:
        pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(t, pairs)

    def grams(df: DataFrame, k: str, c: str) -> DataFrame:
        flat = df.select(k, F.explode(X.let(X.tokens_alnum(c), both)).alias("g")).select(k, F.xxhash64("g").alias("term"))
        return flat.groupBy(k, "term").agg((1 + F.log(F.count("*").cast("double"))).alias("w"))

    d, asked = grams(docs, key, doc_text), grams(queries, qid, query_text)
    n_docs = docs.count()
    smooth = (F.log((1 + n_docs) / (1 + F.count("*"))) + 1).alias("idf")
    idf = d.groupBy("term").agg(smooth)
    # a row's vector keeps the terms that are asked for, and the norm of all of them
    known = counted_broadcast(asked.select("term").distinct().withColumn("asked", F.lit(True)))
    asked_idf = docs.select(F.explode(F.array_distinct(X.let(X.tokens_alnum(doc_text), both))).alias("g")).select(F.xxhash64("g").alias("term")).join(known, "term", "left_semi").groupBy("term").agg(smooth)
    v = d.join(idf, "term").join(known, "term", "left").select(key, (F.col("w") * F.col("idf")).alias("w"), F.when(F.col("asked"), F.col("term")).alias("term"))
    rows = v.groupBy(F.col(key).cast("bigint").alias(key)).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "w"))).alias("x"))
    rows = rows.select(key, "norm", F.transform("x", lambda s: s.term).alias("_t"), F.transform("x", lambda s: s.w).alias("_w"))
    q = asked.join(asked_idf, "term").select(qid, "term", (F.col("w") * F.col("idf")).alias("w"))
    unit = q.groupBy(qid).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = q.join(unit, qid).select(qid, "term", (F.col("w") / F.col("norm")).alias("w"))

    def weigh(part: pd.DataFrame, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = part["_t"].map(len).to_numpy()
        at = np.array([place.get(t, -1) for x in part["_t"] for t in x], np.int64)
        w = np.concatenate(part["_w"].tolist()) if len(at) else np.empty(0)
        i = np.repeat(np.arange(len(part)), size)
        return i[at >= 0], at[at >= 0], (w / part["norm"].to_numpy()[i])[at >= 0]

    return top_matches(rows, key, question_blocks(q, qid, "w"), qid, k, weigh)


def fulltext(index: DataFrame, terms: DataFrame, key: str, qid: str) -> DataFrame:
    """(qid, key, matched, mode): rows that hold all words of the query, or any if no row holds all."""
    size = terms.groupBy(qid).agg(F.count("*").alias("asked"))
    hits = terms.join(index.select(key, "term"), "term").groupBy(qid, key).agg(F.count("*").alias("matched")).join(size, qid)
    full = F.max((F.col("matched") == F.col("asked")).cast("int")).over(Window.partitionBy(qid))
    hits = hits.withColumn("any_full", full)
    return hits.where((F.col("any_full") == 0) | (F.col("matched") == F.col("asked"))).select(qid, key, "matched", F.when(F.col("any_full") == 1, "and").otherwise("or").alias("mode"))


def knn(rows: DataFrame, queries: DataFrame, key: str, vector: str, qid: str, k: int) -> DataFrame:
    """(qid, key, score, rank): exact nearest rows by cosine; a row isn't its own neighbour.

    Queries go in blocks of ``QUERY_BLOCK`` vectors; each task keeps the best k of its rows per query, so little is
    shuffled. Null vectors and vectors of another length take no part; a zero norm gives 0.
    """
    spark, schema = rows.sparkSession, f"{qid} bigint, {key} bigint, score double"
    size = queries.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0]
    if size is None:
        return spark.createDataFrame([], f"{qid} bigint, {key} bigint, score double, rank bigint")
    usable = F.col(vector).isNotNull() & (F.size(vector) == size)
    src = rows.where(usable).select(F.col(key).cast("bigint").alias(key), vector)
    out = None

    def unit(s) -> np.ndarray:
        x = np.array([np.asarray(v, np.float64) for v in s]).reshape(len(s), size)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def one(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([b[0] for b in block]), unit([b[1] for b in block])))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best_s, best_k = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0)
            for b in batches:
                if not len(b):
                    continue
                s = q @ unit(b[vector]).T
                keys = np.broadcast_to(b[key].to_numpy(), s.shape)
                s = np.where(keys == ids[:, None], -np.inf, np.round(s, 9))
                s, keys = np.concatenate([best_s, s], 1), np.concatenate([best_k, keys], 1)
                order = np.lexsort((keys, -s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(s, order, 1), np.take_along_axis(keys, order, 1)
            ok = np.isfinite(best_s)
            yield pd.DataFrame({qid: np.repeat(ids, ok.sum(1)), key: best_k[ok], "score": best_s[ok]})

        return src.mapInPandas(search, schema)

    block: list = []
    for r in queries.where(usable).select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("v")).toLocalIterator():
        block.append((r.q, r.v))
        if len(block) == QUERY_BLOCK:
            out, block = one(block) if out is None else out.unionAll(one(block)), []
    if block or out is None:
        out = one(block) if out is None else out.unionAll(one(block))
    return ranked(out, qid, key, k)


def rrf(lists: list[tuple[DataFrame, float]], qid: str, key: str, k: int = 60) -> DataFrame:
    """(qid, key, score): weighted reciprocal ranks of several ranked lists."""
    parts = [df.select(qid, key, (w / (k + F.col("rank"))).alias("s")) for df, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(qid, key).agg(F.sum("s").alias("score"))


def hybrid_rows(a: DataFrame, b: DataFrame, qid: str, key: str, names: tuple[str, str] = ("lexical", "vector")) -> DataFrame:
    """Both lists' ranks and scores side by side; ranks are null and scores 0 where a list lacks the row."""
    x, y = (df.select(qid, key, F.col("rank").alias(f"{n}_rank"), F.col("score").alias(f"{n}_score")) for df, n in zip((a, b), names))
    return x.join(y, [qid, key], "full_outer").fillna(0.0, [f"{n}_score" for n in names])


def relative_fusion(a: DataFrame, b: DataFrame, qid: str, key: str, alpha: float = 0.5) -> DataFrame:
    """(qid, key, score): scores brought to 0..1 per query and list, then (1 - alpha) a + alpha b."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(qid)
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return df.select(qid, key, F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))

    both = scaled(a, "x").join(scaled(b, "y"), [qid, key], "full_outer")
    return both.select(qid, key, ((1 - alpha) * F.coalesce("x", F.lit(0.0)) + alpha * F.coalesce("y", F.lit(0.0))).alias("score"))


def best_of(scores: DataFrame, qid: str, key: str, owners: DataFrame, owner: str) -> DataFrame:
    """(qid, owner, score): the best score of any of an owner's rows, such as a document's chunks."""
    return scores.join(owners.select(key, owner), key).groupBy(qid, owner).agg(F.max("score").alias("score"))


def reranked(first: DataFrame, scores: DataFrame, qid: str, key: str) -> DataFrame:
    """The list in the order of other scores; rows without one follow in their old order."""
    w = Window.partitionBy(qid).orderBy(F.desc_nulls_last("new"), "rank")
    j = first.join(scores.select(qid, key, F.round("score", 6).alias("new")), [qid, key], "left")
    return j.withColumn("new_rank", F.row_number().over(w).cast("bigint")).select(qid, key, "rank", "new_rank")


def max_sim(query_vectors: DataFrame, doc_vectors: DataFrame, qid: str, key: str, vector: str, own: str | None = None) -> DataFrame:
    """(qid, key, score): mean over a query's vectors of the best cosine with any vector of the document.

    ``query_vectors`` (qid, pos, vector) go in blocks of ``QUERY_BLOCK``; documents' vectors stay where they are.
    A document's vector whose ``own`` id is the query's ``pos`` is passed over.
    """
    kind = dict(doc_vectors.dtypes)[key], dict(query_vectors.dtypes)[qid]
    src, block, flat = doc_vectors.where(F.col(vector).isNotNull()).select(key, vector, *([own] if own else [])), [], None
    for r in query_vectors.where(F.col(vector).isNotNull()).select(qid, "pos", vector).toLocalIterator():
        block.append(tuple(r))
        if len(block) == QUERY_BLOCK:
            one = src.mapInPandas(_best_cosines(src, block, qid, key, vector, own), f"{qid} {kind[1]}, pos bigint, {key} {kind[0]}, s double")
            flat, block = one if flat is None else flat.unionAll(one), []
    if block or flat is None:
        one = src.mapInPandas(_best_cosines(src, block, qid, key, vector, own), f"{qid} {kind[1]}, pos bigint, {key} {kind[0]}, s double")
        flat = one if flat is None else flat.unionAll(one)
    return flat.groupBy(qid, key, "pos").agg(F.max("s").alias("s")).groupBy(qid, key).agg(F.avg("s").alias("score"))


def _best_cosines(src: DataFrame, block: list, qid: str, key: str, vector: str, own: str | None):
    """The best cosine of each query vector of a block with each owner's vectors of a batch."""
    sent = src.sparkSession.sparkContext.broadcast(block)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, pos = [r[0] for r in sent.value], [r[1] for r in sent.value]
        q = np.array([r[2] for r in sent.value], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30) if len(q) else 1
        for b in batches:
            if not len(b) or not len(q):
                continue
            x = np.array(b[vector].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            owner, keys = pd.factorize(b[key])
            order = np.argsort(owner, kind="stable")
            s = q @ x.T
            if own:
                s[np.array(pos)[:, None] == b[own].to_numpy()[None, :]] = -np.inf
            best = np.maximum.reduceat(s[:, order], np.searchsorted(owner[order], np.arange(len(keys))), axis=1)
            at, k = np.nonzero(np.isfinite(best))
            yield pd.DataFrame({qid: np.array(names)[at], "pos": np.array(pos)[at], key: np.array(keys)[k], "s": best[at, k]})

    return go


def metrics(ranking: DataFrame, relevant: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """(qid, hit, recall, reciprocal_rank, ndcg) at ``k`` for each query that has relevant rows."""
    n = relevant.groupBy(qid).agg(F.count("*").alias("n_relevant"))
    hits = ranking.where(F.col("rank") <= k).join(relevant.select(qid, key).distinct(), [qid, key]).groupBy(qid)
    got = hits.agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return n.join(got, qid, "left").select(
        qid, (F.coalesce("found", F.lit(0)) > 0).cast("int").alias("hit"), (F.coalesce("found", F.lit(0)) / F.col("n_relevant")).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )
