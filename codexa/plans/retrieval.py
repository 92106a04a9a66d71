"""Queries of retrieval, fusion and ranking metrics. Lexical ones ask all questions of the evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import retrieval as R
from codexa.plans.registry import query
from codexa.sources.tables import spread, table


def _parts(spark: SparkSession, d: str, distinct: bool = False, chars: bool = False, all_terms: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of the terms asked for (of all, where a score needs them), lengths, and the questions' terms."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    length = F.length("text") if chars else F.size(X.tokens_alnum("text"))
    terms = R.query_terms(table(spark, d, "eval_items"), "item_id", X.tokens_alnum("question"), distinct)
    return R.postings(docs, "doc_id", X.tokens_alnum("text"), None if all_terms else terms), docs.select("doc_id", length.cast("bigint").alias("dl")), terms


_BASE = """tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
len AS (SELECT doc_id, {length} AS dl FROM documents),
st AS (SELECT count(*) AS n_docs, greatest(avg(dl), {floor}) AS avg_dl FROM len),
q AS (SELECT item_id, term, {qtf} AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS term FROM eval_items) GROUP BY item_id, term)"""
_WORDS = "len(regexp_extract_all(lower(text), '[a-z0-9]+'))"


def _bm25_sql(k1: float = 1.5, b: float = 0.75, qtf: str = "count(*)", length: str = _WORDS, floor: float = 0.0, idf: str = "ln(1 + (n_docs - df + 0.5) / (df + 0.5))") -> str:
    base = _BASE.format(length=length, floor=floor, qtf=qtf)
    return f"""{base},
bm AS (SELECT item_id, doc_id, sum(qtf * {idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avg_dl))) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY item_id, doc_id),
bmr AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm)"""


_LAST = "SELECT item_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM {0} WHERE rank <= {1}"


@query("ret_bm25", f"WITH {_bm25_sql(1.2, qtf='1')} {_LAST.format('bmr', 10)}")
def ret_bm25(spark, d):
    """Flagship: the ten best documents of each question."""
    return _bm(spark, d, 10, distinct=True, k1=1.2)


def _bm(spark, d, k=20, distinct=False, chars=False, **kw):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    tokens = X.tokens_alnum("text")
    terms = R.query_terms(table(spark, d, "eval_items"), "item_id", X.tokens_alnum("question"), distinct)
    return R.bm25_top(docs, "doc_id", tokens, F.length("text") if chars else F.size(tokens), terms, "item_id", k, **kw)


@query("ret1_bm25_repeated_terms", f"WITH {_bm25_sql()} {_LAST.format('bmr', 20)}")
def _(spark, d):
    return _bm(spark, d)


@query("ret2_bm25_floored_length", f"WITH {_bm25_sql(floor=1.0)} {_LAST.format('bmr', 20)}")
def _(spark, d):
    return _bm(spark, d, least_average=1.0)


@query("ret3_bm25_char_length", f"WITH {_bm25_sql(1.2, qtf='1', length='length(text)')} {_LAST.format('bmr', 10)}")
def _(spark, d):
    return _bm(spark, d, 10, distinct=True, chars=True, k1=1.2)


@query("ret4_section_search", """WITH c AS (SELECT DISTINCT chunk_id, coalesce(section, '') || ' ' || text AS body, text FROM chunk_records), tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS term FROM c),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1), len AS (SELECT chunk_id, len(regexp_extract_all(lower(body), '[a-z0-9]+')) AS dl FROM c), st AS (SELECT count(*) AS n, avg(dl) AS a FROM len),
q AS (SELECT unnest(['surgical', 'extraction', 'appeal']) AS term),
s AS (SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 2) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (chunk_id), st GROUP BY 1)
SELECT s.chunk_id, score, substring(replace(c.text, chr(10), ' '), 1, 400) AS snippet FROM s JOIN c USING (chunk_id) WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 10""")
def _(spark, d):
    c = table(spark, d, "chunk_records").select("chunk_id", F.concat(F.coalesce("section", F.lit("")), F.lit(" "), F.col("text")).alias("body"), "text").distinct()
    terms = spark.createDataFrame([(1, t, 1) for t in ("surgical", "extraction", "appeal")], "q int, term string, qtf long")
    t = X.tokens_alnum("body")
    s = R.bm25(R.postings(c, "chunk_id", t), c.select("chunk_id", F.size(t).alias("dl")), terms, "chunk_id", "q", k1=1.2)
    out = s.select("chunk_id", F.round("score", 2).alias("score")).join(c, "chunk_id").where("score > 0")
    return out.select("chunk_id", "score", F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 400).alias("snippet")).orderBy(F.desc("score"), "chunk_id").limit(10)


@query("ret5_bm25_okapi", f"""WITH {_BASE.format(length=_WORDS, floor=0.0, qtf='count(*)')}, w AS (SELECT term, ln((n_docs - df + 0.5) / (df + 0.5)) AS raw FROM df, st), f AS (SELECT 0.25 * avg(raw) AS low FROM w), wi AS (SELECT term, CASE WHEN raw < 0 THEN low ELSE raw END AS idf FROM w, f),
bm AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM q JOIN wi USING (term) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY ALL),
bmr AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) {_LAST.format('bmr', 20)}""")
def _(spark, d):
    return R.ranked(R.bm25(*_parts(spark, d, all_terms=True), "doc_id", "item_id", idf="okapi"), "item_id", "doc_id", 20)


@query("ret6_cover_density", f"""WITH {_BASE.format(length=_WORDS, floor=0.0, qtf='1')}, a AS (SELECT item_id, count(*) AS asked FROM q GROUP BY 1), h AS (SELECT item_id, doc_id, count(*) AS matched FROM q JOIN post USING (term) GROUP BY ALL),
x AS (SELECT h.*, asked, max(CAST(matched = asked AS INTEGER)) OVER (PARTITION BY item_id) AS f FROM h JOIN a USING (item_id)), y AS (SELECT item_id, doc_id, matched / (1 + ln(1 + dl)) AS x FROM x JOIN len USING (doc_id) WHERE f = 0 OR matched = asked),
z AS (SELECT item_id, doc_id, round(x / (x + 1), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(x / (x + 1), 6) DESC, doc_id) AS rank FROM y) SELECT item_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM z WHERE rank <= 10""")
def _(spark, d):
    """Full-text rank by coverage: matched share of the query, saturated; not the server's own formula."""
    index, lengths, terms = _parts(spark, d, distinct=True)
    hit = R.fulltext(index, terms, "doc_id", "item_id").join(lengths, "doc_id")
    s = hit.select("item_id", "doc_id", (F.col("matched") / (1 + F.log(1 + F.col("dl")))).alias("x")).select("item_id", "doc_id", (F.col("x") / (F.col("x") + 1)).alias("score"))
    return R.ranked(s, "item_id", "doc_id", 10)


@query("ret7_fulltext_and_or", f"""WITH {_BASE.format(length='0', floor=0.0, qtf='1')}, a AS (SELECT item_id, count(*) AS asked FROM q GROUP BY 1), h AS (SELECT item_id, doc_id, count(*) AS matched FROM q JOIN post USING (term) GROUP BY ALL),
x AS (SELECT h.*, asked, max(CAST(matched = asked AS INTEGER)) OVER (PARTITION BY item_id) AS f FROM h JOIN a USING (item_id))
SELECT item_id, doc_id, CAST(matched AS BIGINT) AS matched, CASE WHEN f = 1 THEN 'and' ELSE 'or' END AS mode FROM x WHERE f = 0 OR matched = asked""")
def _(spark, d):
    index, _, terms = _parts(spark, d, distinct=True)
    return R.fulltext(index, terms, "doc_id", "item_id")


_TFIDF = """g AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
gq AS (SELECT item_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS t FROM eval_items),
dt AS (SELECT doc_id, term, 1 + ln(count(*)) AS w FROM (SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM g) GROUP BY ALL),
qt AS (SELECT item_id, term, 1 + ln(count(*)) AS w FROM (SELECT item_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM gq) GROUP BY ALL),
n AS (SELECT count(*) AS n_docs FROM documents), idf AS (SELECT term, ln((1 + n_docs) / (1 + count(*))) + 1 AS idf FROM dt, n GROUP BY term, n_docs),
dv AS (SELECT doc_id, term, w * idf AS w FROM dt JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dv GROUP BY 1),
qv AS (SELECT item_id, term, w * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY 1),
tf AS (SELECT item_id, doc_id, sum(qv.w * dv.w) / any_value(dn.norm) / any_value(qn.norm) AS score FROM qv JOIN dv USING (term) JOIN dn USING (doc_id) JOIN qn USING (item_id) GROUP BY item_id, doc_id),
tfr AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM tf)"""


def _tf(spark, d, k=20):
    return R.ranked(R.tfidf(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"), "doc_id", "item_id", "text", "question", k), "item_id", "doc_id", k)


@query("ret8_tfidf", f"WITH {_TFIDF} {_LAST.format('tfr', 10)}")
def _(spark, d):
    return _tf(spark, d, 10)


_VEC = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
kn AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
knr AS (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank FROM kn)"""


def _kn(spark, d, k=10):
    """Queries: every vector whose id is divisible by 50, against all rows."""
    v = table(spark, d, "embeddings")
    return R.knn(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding", "query_id", k)


@query("ret9_vector_search", f"WITH {_VEC} SELECT query_id, vec_id, score, CAST(rank AS BIGINT) AS rank FROM knr WHERE rank <= 10")
def _(spark, d):
    return _kn(spark, d)


@query("ret10_windows_max_pool", f"WITH {_VEC} SELECT query_id, label, round(max(kn.score), 6) AS score FROM kn JOIN v USING (vec_id) GROUP BY ALL")
def _(spark, d):
    """A label owns its vectors as a document owns its token windows."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("pos"), "embedding")
    return R.max_sim(q, v, "query_id", "label", "embedding", own="vec_id").select("query_id", "label", F.round("score", 6).alias("score"))


_RRF = f"""WITH {_bm25_sql()}, {_TFIDF}, u AS (SELECT item_id, doc_id, {{0}} / (60 + rank) AS s FROM bmr WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, {{1}} / (60 + rank) FROM tfr WHERE rank <= 20), r AS (SELECT item_id, doc_id, sum(s) AS score FROM u GROUP BY ALL),
rr AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM r) """


def _fused(spark, d, a, b, k=10):
    return R.ranked(R.rrf([(_bm(spark, d), a), (_tf(spark, d), b)], "item_id", "doc_id"), "item_id", "doc_id", k)


@query("ret11_rank_fusion", _RRF.format("2.0", "1.0") + _LAST.format("rr", 10))
def _(spark, d):
    return _fused(spark, d, 2.0, 1.0)


@query("ret12_hybrid_rows", f"WITH {_bm25_sql()}, {_TFIDF} SELECT coalesce(b.item_id, t.item_id) AS item_id, coalesce(b.doc_id, t.doc_id) AS doc_id, CAST(b.rank AS BIGINT) AS lexical_rank, coalesce(b.score, 0) AS lexical_score, CAST(t.rank AS BIGINT) AS vector_rank, coalesce(t.score, 0) AS vector_score FROM (SELECT * FROM bmr WHERE rank <= 20) b FULL JOIN (SELECT * FROM tfr WHERE rank <= 20) t ON b.item_id = t.item_id AND b.doc_id = t.doc_id")
def _(spark, d):
    return R.hybrid_rows(_bm(spark, d), _tf(spark, d), "item_id", "doc_id")


@query("ret13_hybrid_candidates", _RRF.format("1.0", "1.0") + _LAST.format("rr", 25))
def _(spark, d):
    return _fused(spark, d, 1.0, 1.0, 25)


@query("ret14_relative_fusion", f"""WITH {_bm25_sql()}, {_TFIDF}, a AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM bmr WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id)),
b AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM tfr WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id)),
m AS (SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, 0.3 * coalesce(x, 0) + 0.7 * coalesce(y, 0) AS s FROM a FULL JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
r AS (SELECT item_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM m) {_LAST.format('r', 10)}""")
def _(spark, d):
    return R.ranked(R.relative_fusion(_bm(spark, d), _tf(spark, d), "item_id", "doc_id", 0.7), "item_id", "doc_id", 10)


@query("ret15_ensemble", _RRF.format("0.5", "0.5") + _LAST.format("rr", 10))
def _(spark, d):
    return _fused(spark, d, 0.5, 0.5)


_CHUNK_HITS = """tok AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM rag_chunks WHERE content IS NOT NULL), post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
len AS (SELECT id, len(regexp_extract_all(lower(content), '[a-z0-9]+')) AS dl FROM rag_chunks WHERE content IS NOT NULL), st AS (SELECT count(*) AS n, avg(dl) AS a FROM len), q AS (SELECT unnest(['fluoride', 'varnish', 'appeal']) AS term),
h AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (id), st GROUP BY 1)"""


def _chunk_hits(spark, d):
    c = table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", "content")
    t = X.tokens_alnum("content")
    terms = spark.createDataFrame([(1, x, 1) for x in ("fluoride", "varnish", "appeal")], "q int, term string, qtf long")
    return R.bm25(R.postings(c, "id", t), c.select("id", F.size(t).alias("dl")), terms, "id", "q")


@query("ret16_parent_documents", f"WITH {_CHUNK_HITS} SELECT c.document_id, r.title, round(max(score), 6) AS score FROM h JOIN rag_chunks c USING (id) LEFT JOIN rag_documents r ON r.id = c.document_id GROUP BY ALL")
def _(spark, d):
    c = table(spark, d, "rag_chunks")
    best = R.best_of(_chunk_hits(spark, d), "q", "id", c, "document_id")
    titles = table(spark, d, "rag_documents").select(F.col("id").alias("document_id"), "title")
    return best.join(titles, "document_id", "left").select("document_id", "title", F.round("score", 6).alias("score"))


@query("ret17_parent_child_tables", f"WITH {_CHUNK_HITS}, t AS (SELECT h.id, c.document_id, round(score, 6) AS score FROM h JOIN rag_chunks c USING (id) ORDER BY round(score, 6) DESC, h.id LIMIT 30) SELECT document_id, max(score) AS score, CAST(count(*) AS BIGINT) AS children FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "document_id")
    top = _chunk_hits(spark, d).select("id", F.round("score", 6).alias("score")).join(c, "id").orderBy(F.desc("score"), "id").limit(30)
    return top.groupBy("document_id").agg(F.max("score").alias("score"), F.count("*").alias("children")).orderBy(F.desc("score"), "document_id").limit(5)


@query("ret18_flat_chunks", f"WITH {_CHUNK_HITS} SELECT id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, id LIMIT 6")
def _(spark, d):
    return _chunk_hits(spark, d).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(6)


@query("ret19_mean_vectors", "WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL) SELECT label, round(sqrt(sum(x * x)), 5) AS norm FROM p GROUP BY label")
def _(spark, d):
    """One vector for each owner: the mean of its rows."""
    p = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return p.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 5).alias("norm"))


@query("ret27_reranked", f"WITH {_bm25_sql()}, {_TFIDF}, f AS (SELECT * FROM bmr WHERE rank <= 20) SELECT f.item_id, f.doc_id, CAST(f.rank AS BIGINT) AS rank, CAST(row_number() OVER (PARTITION BY f.item_id ORDER BY t.score DESC NULLS LAST, f.rank) AS BIGINT) AS new_rank FROM f LEFT JOIN (SELECT * FROM tfr WHERE rank <= 10) t ON t.item_id = f.item_id AND t.doc_id = f.doc_id")
def _(spark, d):
    return R.reranked(_bm(spark, d), _tf(spark, d, 10), "item_id", "doc_id")


@query("ret28_backend_overlap", f"WITH {_bm25_sql()}, {_TFIDF} SELECT b.item_id, CAST(count(t.doc_id) AS BIGINT) AS shared, round(count(t.doc_id) / 10.0, 2) AS share FROM (SELECT * FROM bmr WHERE rank <= 10) b LEFT JOIN (SELECT * FROM tfr WHERE rank <= 10) t ON b.item_id = t.item_id AND b.doc_id = t.doc_id GROUP BY 1")
def _(spark, d):
    b, t = _bm(spark, d, 10).select("item_id", "doc_id"), _tf(spark, d, 10).select("item_id", "doc_id", F.lit(1).alias("both"))
    return b.join(t, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count("both").alias("shared"), F.round(F.count("both") / 10.0, 2).alias("share"))


@query("ret31_late_interaction", """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
m AS (SELECT q.vec_id // 200 AS query_id, q.vec_id, p.label, max(list_dot_product(q.e, p.e)) AS s FROM u q, u p WHERE q.vec_id % 50 = 0 GROUP BY ALL) SELECT query_id, label, round(avg(s), 5) AS score FROM m GROUP BY ALL""")
def _(spark, d):
    """Every fiftieth vector is a query token; four of them make a query, a label's vectors a document."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.expr("vec_id div 200").alias("query_id"), F.col("vec_id").alias("pos"), "embedding")
    return R.max_sim(q, v, "query_id", "label", "embedding").select("query_id", "label", F.round("score", 5).alias("score"))


@query("ret32_heading_boost", """WITH c AS (SELECT DISTINCT chunk_id, section, text, pages FROM chunk_records), b AS (SELECT chunk_id, len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(section, '')), '[a-z0-9]+')), ['surgical', 'extraction', 'rules'])) AS shared, CAST(regexp_matches(lower(text), 'surgical extraction') AS INTEGER) AS said, list_contains(pages, 1) OR list_contains(pages, 2) AS early FROM c)
SELECT chunk_id, round(max(said + 0.75 * shared + CASE WHEN early THEN 1.0 ELSE 0.0 END), 2) AS score FROM b WHERE said = 1 GROUP BY 1""")
def _(spark, d):
    c = table(spark, d, "chunk_records").select("chunk_id", "section", "text", "pages").distinct()
    shared = F.size(F.array_intersect(F.array_distinct(X.tokens_alnum(F.coalesce("section", F.lit("")))), F.array(*map(F.lit, ("surgical", "extraction", "rules")))))
    early = F.coalesce(F.arrays_overlap("pages", F.array(F.lit(1), F.lit(2))), F.lit(False))
    hit = c.where(F.lower("text").contains("surgical extraction"))
    return hit.groupBy("chunk_id").agg(F.round(F.max(1 + 0.75 * shared + F.when(early, 1.0).otherwise(0.0)), 2).alias("score"))


@query("ret33_gated", f"WITH {_bm25_sql()}, {_TFIDF}, gt AS (SELECT item_id, max(score) >= 0.25 AS ok FROM tfr GROUP BY 1) SELECT t.item_id, t.doc_id, 'vector' AS leg FROM tfr t JOIN gt USING (item_id) WHERE ok AND t.rank <= 5 UNION ALL SELECT b.item_id, b.doc_id, 'bm25' FROM bmr b LEFT JOIN gt USING (item_id) WHERE NOT coalesce(ok, false) AND b.rank <= 5")
def _(spark, d):
    t, b = _tf(spark, d, 5), _bm(spark, d, 5)
    gate = t.groupBy("item_id").agg((F.max("score") >= 0.25).alias("ok"))
    x = t.join(gate, "item_id").where("ok").select("item_id", "doc_id", F.lit("vector").alias("leg"))
    return x.unionByName(b.join(gate, "item_id", "left").where(~F.coalesce("ok", F.lit(False))).select("item_id", "doc_id", F.lit("bm25").alias("leg")))


@query("ret34_stages", _RRF.format("1.0", "1.0") + "SELECT 'bm25' AS stage, item_id, doc_id, CAST(rank AS BIGINT) AS rank FROM bmr WHERE rank <= 5 UNION ALL SELECT 'tfidf', item_id, doc_id, CAST(rank AS BIGINT) FROM tfr WHERE rank <= 5 UNION ALL SELECT 'rrf', item_id, doc_id, CAST(rank AS BIGINT) FROM rr WHERE rank <= 5")
def _(spark, d):
    stage = lambda df, n: df.where("rank <= 5").select(F.lit(n).alias("stage"), "item_id", "doc_id", "rank")
    return stage(_bm(spark, d), "bm25").unionByName(stage(_tf(spark, d), "tfidf")).unionByName(stage(_fused(spark, d, 1.0, 1.0), "rrf"))


_METRIC = f"""WITH {_VEC}, rel AS (SELECT a.vec_id AS query_id, b.vec_id FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
g AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM knr JOIN rel USING (query_id, vec_id) WHERE rank <= 10 GROUP BY 1)
SELECT n.query_id, CAST(coalesce(found, 0) > 0 AS INTEGER) AS hit, round(coalesce(found, 0) / n, 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN g USING (query_id)"""


def _metrics(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    a = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    relevant = a.join(v, "label").where("query_id <> vec_id").select("query_id", "vec_id")
    m = R.metrics(_kn(spark, d), relevant, "query_id", "vec_id", 10)
    return m.select("query_id", "hit", *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")])


@query("eva1_4_ranking_metrics", _METRIC)
def _(spark, d):
    """Recall, reciprocal rank, nDCG and hit at ten; relevant are the vectors of the same label."""
    return _metrics(spark, d)


@query("agg24_mean_metrics", f"SELECT round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({_METRIC})")
def _(spark, d):
    return _metrics(spark, d).agg(F.round(F.avg("hit"), 6).alias("hit"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query("eva11_threshold_gate", f"SELECT name, round(value, 6) AS value, value >= least AS passed FROM (SELECT unnest(['hit', 'mrr', 'ndcg']) AS name, unnest([avg(hit), avg(reciprocal_rank), avg(ndcg)]) AS value, unnest([0.9, 0.8, 0.82]) AS least FROM ({_METRIC}))")
def _(spark, d):
    m = _metrics(spark, d).agg(F.avg("hit").alias("hit"), F.avg("reciprocal_rank").alias("mrr"), F.avg("ndcg").alias("ndcg"))
    long = m.unpivot([], ["hit", "mrr", "ndcg"], "name", "value")
    least = F.when(F.col("name") == "hit", 0.9).when(F.col("name") == "mrr", 0.8).otherwise(0.82)
    return long.select("name", F.round("value", 6).alias("value"), (F.col("value") >= least).alias("passed"))


@query("win12_first_hit_rank", f"WITH {_VEC} SELECT k.query_id, CAST(min(CASE WHEN a.label = b.label THEN rank END) AS BIGINT) AS first_hit FROM knr k JOIN v a ON a.vec_id = k.query_id JOIN v b ON b.vec_id = k.vec_id WHERE rank <= 10 GROUP BY 1")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    j = _kn(spark, d).join(v, "vec_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    return j.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("want"), F.col("rank"))).alias("first_hit"))
