"""Problem 5: similar vectors by low-dimensional stable projections in a kd-tree.

Unit vectors are projected by Gaussian (2-stable) vectors: the projections of
two vectors at distance d differ by d times a standard normal in each
dimension. A kd-tree splits one projection after the other at the median. A
search walks the cells in the order of their projected distance, verifies
their vectors exactly, and stops where a chi-square test says that a
neighbour at distance d is unlikely to lie beyond. The planes between two
neighbours cut their displacement at a uniform place, so a third of its square
is expected between a vector and the plane: that is the test's scale.

The upper levels of the tree are shards. They are fitted seven levels at a
time: the first on a sample of ``fit_rows`` vectors, the next within each
shard so far on a sample of about as many of its own vectors, in parallel, so
that shards stay alike in size however many there are and only the cuts come
to the driver. Each shard's own tree is built where it is searched, over all
of its vectors. A vector travels to the shards that the test can't rule out.
Exact copies are one vector, so a hot group is one row; ``copies`` says which
ids a vector stands for.

Defined results: vectors that are null, of another length, not finite or all
zero take no part. Ties in similarity go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.operators.graph import ensure_checkpoint_dir

DIM, SHARD_ROWS, LEAF_ROWS, FIT_ROWS = 64, 32_768, 48, 8_000
#: Levels of the tree fitted on one sample, so that each of its leaves has about 60 sampled vectors.
STEP = 7
#: Projections there are: a tree of as many levels would hold 2**96 leaves.
MOST_LEVELS = 96
#: Copies of one vector that are paired with one another; of a larger group each copy is paired with the first.
EXPAND = 100


def chi2_quantile(p: float, dof: int) -> float:
    """Wilson and Hilferty's approximation."""
    t = math.sqrt(-2 * math.log(1 - p))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return dof * (1 - 2 / (9 * dof) + z * math.sqrt(2 / (9 * dof))) ** 3


def reach(d2: np.ndarray | float, depth: int, p: float) -> np.ndarray | float:
    """Projected square distance from which on a neighbour at square distance ``d2`` is unlikely (less than 1 - p)."""
    angle = np.arccos(np.clip(1 - np.asarray(d2) / 2, -1, 1))
    dof = max(1, math.ceil(depth * float(np.max(angle)) / math.pi)) if depth else 1
    return np.asarray(d2) / 3 * chi2_quantile(p, dof)


def projections(levels: int, dim: int = DIM) -> np.ndarray:
    return np.random.default_rng(20240501).standard_normal((MOST_LEVELS, dim))[:levels].T.astype(np.float32)


class Tree:
    """Median splits, level l along projection ``first + l``; node i has the children 2i+1 and 2i+2."""

    def __init__(self, x: np.ndarray, depth: int, first: int = 0):
        self.depth, self.first = depth, first
        self.cut = np.zeros((1 << depth) - 1, np.float32)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            v, base = x[:, first + level], (1 << level) - 1
            order = np.lexsort((v, node))
            starts = np.searchsorted(node[order], np.arange(base, base + (1 << level)))
            ends = np.append(starts[1:], len(x))
            for k, (s, e) in enumerate(zip(starts, ends)):
                self.cut[base + k] = v[order[(s + e) // 2]] if e > s else 0
            node = 2 * node + 1 + (v >= self.cut[node])

    def extend(self, step: int, cuts: dict[int, np.ndarray]) -> None:
        """Adds the levels of the trees that were fitted within the leaves."""
        depth = self.depth + step
        cut = np.zeros((1 << depth) - 1, np.float32)
        cut[: len(self.cut)] = self.cut
        for leaf, sub in cuts.items():
            for level in range(step):
                wide, base = 1 << level, (1 << self.depth + level) - 1
                cut[base + leaf * wide : base + (leaf + 1) * wide] = sub[wide - 1 : 2 * wide - 1]
        self.depth, self.cut = depth, cut

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + 1 + (x[:, self.first + level] >= self.cut[node])
        return node - (1 << self.depth) + 1

    def probe(self, x: np.ndarray, most: np.ndarray, spent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, projected square distance of the leaf) of all leaves nearer than ``most``."""
        q, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        cost = np.zeros(len(x), np.float32) if spent is None else spent.astype(np.float32)
        for level in range(self.depth):
            off = x[q, self.first + level] - self.cut[node]
            right = off >= 0
            far = cost + off * off
            go = far <= most[q]
            node = np.concatenate([2 * node + 1 + right, (2 * node + 2 - right)[go]])
            q, cost = np.concatenate([q, q[go]]), np.concatenate([cost, far[go]])
        return q, node - (1 << self.depth) + 1, cost


def usable(column: str = "embedding", dim: int = DIM) -> Column:
    e = F.col(column)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return e.isNotNull() & (F.size(e) == dim) & ~bad & F.exists(e, lambda x: x != 0)


def _unit(s: pd.Series) -> np.ndarray:
    x = np.array(s.tolist(), dtype=np.float64).reshape(len(s), -1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) if len(x) else np.zeros((0, DIM), np.float32)


def _bytes(x: np.ndarray) -> pd.Series:
    """Vectors as they travel: four bytes a number."""
    return pd.Series([r.tobytes() for r in np.ascontiguousarray(x, np.float32)], dtype=object)


def _vectors(s: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(s), np.float32).reshape(len(s), dim)


def _shards(vectors: DataFrame, n: int, shard_rows: int, fit_rows: int, dim: int) -> Tree:
    """The tree over shards of about ``shard_rows`` of the ``n`` vectors (id, embedding)."""
    depth = max(0, math.ceil(math.log2(max(1, n) / shard_rows))) if n else 0
    place = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40))

    def share(rows: float) -> DataFrame:
        return vectors.where(place < math.ceil(min(1.0, rows / n) * (1 << 40)))

    # twice the sample by hash first, so that what tasks send to the driver stays about that, however many tasks there are
    sample = [r.embedding for r in share(2 * fit_rows).select("embedding", place.alias("h")).orderBy("h").limit(fit_rows).collect()] if depth else []
    first = min(depth, STEP) if sample else 0
    tree = Tree(_unit(pd.Series(sample)) @ projections(first, dim) if first else np.zeros((0, 0), np.float32), first)
    while sample and tree.depth < depth:
        step, at = min(STEP, depth - tree.depth), tree.depth
        sent = vectors.sparkSession.sparkContext.broadcast(tree)

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                proj = _unit(b.embedding) @ projections(at + step, dim)
                yield pd.DataFrame({"leaf": sent.value.home(proj), "v": _bytes(proj[:, at:])})

        def fit(b: pd.DataFrame) -> pd.DataFrame:
            sub = Tree(_vectors(b.v, step), step)
            return pd.DataFrame({"leaf": b.leaf.iloc[:1].to_numpy(), "cut": _bytes(sub.cut[None, :])})

        rows = share(float(fit_rows) * (1 << at)).select("embedding").mapInPandas(route, "leaf bigint, v binary")
        cuts = rows.groupBy("leaf").applyInPandas(fit, "leaf bigint, cut binary").collect()  # one number a shard
        tree.extend(step, {r.leaf: np.frombuffer(r.cut, np.float32) for r in cuts})
    return tree


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64))


def _local(data: np.ndarray, first: int, leaf_rows: int) -> tuple[Tree, np.ndarray, np.ndarray, np.ndarray]:
    """The shard's own tree, its vectors in leaf order, and each leaf's range."""
    depth = max(0, min(24, math.ceil(math.log2(max(1, len(data)) / leaf_rows))))
    proj = data @ projections(first + depth, data.shape[1])
    tree = Tree(proj, depth, first)
    leaf = tree.home(proj)
    order = np.argsort(leaf, kind="stable")
    edge = np.searchsorted(leaf[order], np.arange((1 << depth) + 1))
    return tree, order, edge, proj


def distinct_vectors(chunks: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, embedding): usable vectors, copies under their smallest id."""
    src = chunks.where(F.col("id").isNotNull() & usable(dim=dim)).select("id", "embedding")
    return src.groupBy("embedding").agg(F.min("id").alias("id"))


def copies(chunks: DataFrame, dim: int = DIM, salts: int = 32) -> DataFrame:
    """(rep, id) of vectors that have copies, the one that stands for them included.

    Copies are known by two hashes of the vector; the join with a hot group's rows is salted.
    """
    hashes = F.xxhash64("embedding").alias("h"), F.hash("embedding").alias("g")
    src = chunks.where(F.col("id").isNotNull() & usable(dim=dim)).select("id", *hashes, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    many = src.groupBy("h", "g").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last")
    many = many.select("h", "g", "rep", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return src.join(many, ["h", "g", "salt"]).select("rep", "id").distinct()


def pairs_above(chunks: DataFrame, least: float = 0.9, p: float = 0.995, dim: int = DIM, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id_a, id_b, similarity): pairs of vectors with a cosine of at least ``least``, smaller id first.

    The distance is given here, so the test stops every walk at the same projected distance: all leaves within it are
    taken at once, with those of many vectors together.
    Of more than ``EXPAND`` exact copies each is paired with the first only, as are their neighbours; ``copies`` has
    the members of every group.
    """
    vectors = distinct_vectors(chunks, dim)
    n = chunks.where(usable(dim=dim)).count()
    src = chunks.where(F.col("id").isNotNull() & usable(dim=dim))
    top = _shards(src, n, shard_rows, fit_rows, dim)
    d2 = 2 - 2 * least

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(b.embedding)
            proj = x @ projections(top.depth, dim) if top.depth else np.zeros((len(x), 0), np.float32)
            home = top.home(proj)
            # a pair in two shards is found from the one with the smaller number
            q, leaf, cost = top.probe(proj, np.full(len(x), reach(d2, top.depth + 9, p), np.float32))
            keep = leaf >= home[q]
            q, leaf, cost = q[keep], leaf[keep], cost[keep]
            yield pd.DataFrame({"shard": leaf, "own": leaf == home[q], "spent": cost, "id": b.id.to_numpy()[q], "v": _bytes(x[q])})

    def search(b: pd.DataFrame) -> pd.DataFrame:
        x, own, ids = _vectors(b.v, dim), b.own.to_numpy(), b.id.to_numpy()
        data, data_ids = x[own], ids[own]
        out_a, out_b, out_s = [], [], []
        if len(data):
            tree, order, edge, _ = _local(data, top.depth, leaf_rows)
            data, data_ids = data[order], data_ids[order]
            proj = x @ projections(top.depth + tree.depth, dim)
            r = np.full(len(x), reach(d2, top.depth + tree.depth, p), np.float32)
            for s in range(0, len(x), 8192):
                part = slice(s, s + 8192)
                q, leaf, _ = tree.probe(proj[part], r[part], b.spent.to_numpy()[part])
                o = np.argsort(leaf, kind="stable")
                q, leaf = q[o] + s, leaf[o]
                at = np.searchsorted(leaf, np.arange(len(edge)))
                for k in np.flatnonzero(at[1:] > at[:-1]):
                    qs = q[at[k] : at[k + 1]]
                    hit_q, hit_d = np.nonzero(x[qs] @ data[edge[k] : edge[k + 1]].T >= least - 1e-4)
                    if len(hit_q):
                        i, j = qs[hit_q], edge[k] + hit_d
                        ok = (ids[i] != data_ids[j])
                        i, j = i[ok], j[ok]
                        c = _cosine(x[i], data[j])
                        out_a.append(np.minimum(ids[i], data_ids[j]))
                        out_b.append(np.maximum(ids[i], data_ids[j]))
                        out_s.append(c)
        cat = lambda v, t: np.concatenate(v) if v else np.empty(0, t)
        out = pd.DataFrame({"id_a": cat(out_a, "int64"), "id_b": cat(out_b, "int64"), "similarity": cat(out_s, "float64")})
        return out[out.similarity >= least - 1e-7].drop_duplicates(["id_a", "id_b"])

    routed = vectors.select("id", "embedding").mapInPandas(route, "shard bigint, own boolean, spent float, id bigint, v binary")
    # about one shard a task, however few partitions the session shuffles into
    pairs = routed.repartition(2 << top.depth, "shard").groupBy("shard").applyInPandas(search, "id_a bigint, id_b bigint, similarity double")
    pairs = pairs.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))
    return _with_copies(pairs, copies(chunks, dim))


def _with_copies(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of representatives, and what follows for their copies."""
    size = held.groupBy("rep").agg(F.count("*").alias("n"))
    small = held.join(size.where(F.col("n") <= EXPAND), "rep").select("rep", "id")
    a, b = small.select(F.col("rep").alias("id_a"), F.col("id").alias("xa")), small.select(F.col("rep").alias("id_b"), F.col("id").alias("xb"))
    between = pairs.join(a, "id_a", "left").join(b, "id_b", "left").select(F.coalesce("xa", "id_a").alias("a"), F.coalesce("xb", "id_b").alias("b"), "similarity")
    within = a.join(b, a.id_a == b.id_b).where("xa < xb").select(F.col("xa").alias("a"), F.col("xb").alias("b"), F.lit(1.0).alias("similarity"))
    star = held.join(size.where(F.col("n") > EXPAND), "rep").where("rep <> id").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    rows = between.unionAll(within).unionAll(star)
    return rows.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), "similarity").distinct()


def _nearest_in(tree: Tree, edge: np.ndarray, data: np.ndarray, ids: np.ndarray, qx: np.ndarray, qid: np.ndarray, proj: np.ndarray, spent: np.ndarray, bound: np.ndarray, k: int, depth: int, p: float) -> list[tuple]:
    """(id, other id, similarity) of the ``k`` best of a shard for each query, nearer than its bound.

    Leaves are taken in rounds of growing projected distance, for all queries together: each query's own leaf, those
    within a quarter of what the test allows, and the rest. After each round the test holds the k-th neighbour so far.
    """
    bound, done = bound.copy(), np.full(len(qx), -1.0)
    best = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)  # query, similarity, id
    for share in (0.0, 0.25, 1.0):
        limit = np.maximum(spent, [share * reach(d, depth, p) for d in bound]).astype(np.float32)
        q, leaf, cost = tree.probe(proj, limit, spent)
        new = cost > done[q]
        q, leaf = q[new], leaf[new]
        order = np.argsort(leaf, kind="stable")
        q, leaf = q[order], leaf[order]
        at = np.searchsorted(leaf, np.arange(len(edge)))
        met = [best]
        for f in np.flatnonzero(at[1:] > at[:-1]):
            qs, rows = q[at[f] : at[f + 1]], slice(edge[f], edge[f + 1])
            sim = qx[qs] @ data[rows].T
            i, j = np.nonzero((sim >= (1 - bound[qs] / 2 - 1e-6)[:, None]) & (ids[rows][None, :] != qid[qs][:, None]))
            met.append((qs[i], sim[i, j].astype(np.float64), ids[rows][j]))
        who, sim, other = map(np.concatenate, zip(*met))
        order = np.lexsort((other, -sim, who))
        who, sim, other = who[order], sim[order], other[order]
        keep = np.arange(len(who)) - np.searchsorted(who, who) < k
        best = who, sim, other = who[keep], sim[keep], other[keep]
        full = np.bincount(who, minlength=len(qx)) == k
        last = np.searchsorted(who, np.arange(len(qx)), "right") - 1
        bound[full] = np.minimum(bound[full], 2 - 2 * sim[last[full]])
        done = limit
    return list(zip(qid[best[0]].tolist(), best[2].tolist(), best[1].tolist()))


def nearest(chunks: DataFrame, queries: DataFrame, k: int = 10, p: float = 0.995, dim: int = DIM, shard_rows: int = SHARD_ROWS, leaf_rows: int = 256, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, rank, other_id, similarity): the ``k`` most similar other rows of each query row, in blocks by shard.

    The home shard gives a bound for the k-th distance; the query then travels to the shards within its reach.
    """
    src = chunks.where(F.col("id").isNotNull() & usable(dim=dim)).select("id", "embedding")
    ensure_checkpoint_dir(chunks)
    qs = queries.where(F.col("id").isNotNull() & usable(dim=dim)).select("id", "embedding")
    top = _shards(src, src.count(), shard_rows, fit_rows, dim)

    def project(x: np.ndarray) -> np.ndarray:
        return x @ projections(top.depth, dim) if top.depth else np.zeros((len(x), 0), np.float32)

    def place(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = _unit(b.embedding)
                yield pd.DataFrame({"shard": top.home(project(x)), "q": query, "spent": np.float32(0), "bound": np.float32(4), "id": b.id, "v": _bytes(x)})

        return run

    schema = "shard bigint, q boolean, spent float, bound float, id bigint, v binary"

    def search(b: pd.DataFrame) -> pd.DataFrame:
        isq = b.q.to_numpy()
        x, ids = _vectors(b.v, dim), b.id.to_numpy()
        qx, qid, data, did = x[isq], ids[isq], x[~isq], ids[~isq]
        spent, bound = b.spent.to_numpy()[isq], b.bound.to_numpy()[isq].astype(np.float64)
        rows: list[tuple] = []
        if len(qx) and len(data):
            tree, order, edge, _ = _local(data, top.depth, leaf_rows)
            data, did = data[order], did[order]
            depth = top.depth + tree.depth
            proj = qx @ projections(depth, dim)
            for s in range(0, len(qx), 2048):
                part = slice(s, s + 2048)
                rows += _nearest_in(tree, edge, data, did, qx[part], qid[part], proj[part], spent[part], bound[part], k, depth, p)
        return frame(rows, ["id", "other_id", "similarity"]).astype({"id": "int64", "other_id": "int64", "similarity": "float64"})

    out = "id bigint, other_id bigint, similarity double"
    homes = src.mapInPandas(place(False), schema)
    first = homes.unionAll(qs.mapInPandas(place(True), schema)).groupBy("shard").applyInPandas(search, out)
    bounds = first.groupBy("id").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).select("id", F.when(F.col("n") >= k, 2 - 2 * F.col("s")).otherwise(F.lit(4.0)).alias("d2"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _unit(b.embedding)
            proj = project(x)
            r = np.array([reach(d, top.depth + 6, p) for d in b.d2], np.float32)
            q, leaf, cost = top.probe(proj, r)
            away = leaf != top.home(proj)[q]
            q, leaf, cost = q[away], leaf[away], cost[away]
            yield pd.DataFrame({"shard": leaf, "q": True, "spent": cost, "bound": b.d2.to_numpy()[q].astype(np.float32), "id": b.id.to_numpy()[q], "v": _bytes(x[q])})

    far = qs.join(bounds, "id", "left").withColumn("d2", F.coalesce("d2", F.lit(4.0))).select("id", "embedding", "d2").mapInPandas(spread, schema).checkpoint()
    visited = far.select("shard").distinct()  # at most one row a shard
    second = homes.join(F.broadcast(visited), "shard", "left_semi").select(*far.columns).unionAll(far).groupBy("shard").applyInPandas(search, out)
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other_id")
    return first.unionAll(second).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "other_id", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_above(spark.read.parquet(f"{sf_dir}/rag_chunks.parquet")).select("id_a", "id_b")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every row whose id is divisible by 50, against all rows."""
    chunks = spark.read.parquet(f"{sf_dir}/rag_chunks.parquet")
    return nearest(chunks, chunks.where("id % 50 = 0"))


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rep, id): which vectors are exact copies of one another, by the smallest id."""
    return copies(spark.read.parquet(f"{sf_dir}/rag_chunks.parquet"))
