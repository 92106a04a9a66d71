"""Queries of joins, windows, sorts, set operations, scans and sinks over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import ranges as G
from codexa.operators import relational as R
from codexa.plans.registry import query
from codexa.sources.tables import table

N = lambda: F.count("*").alias("n")


@query("join1_chunks_with_titles", "SELECT c.id, r.title FROM rag_chunks c JOIN rag_documents r ON r.id = c.document_id")
def _(spark, d):
    r = table(spark, d, "rag_documents").select(F.col("id").alias("document_id"), "title")
    return table(spark, d, "rag_chunks").select("id", "document_id").join(r, "document_id").select("id", "title")


@query("join2_left_join_count", "SELECT r.id, CAST(count(c.id) AS BIGINT) AS n FROM rag_documents r LEFT JOIN rag_chunks c ON c.document_id = r.id GROUP BY 1")
def _(spark, d):
    n = table(spark, d, "rag_chunks").groupBy("document_id").agg(N())  # counted before the join, so that little is joined
    return table(spark, d, "rag_documents").select("id").join(n.withColumnRenamed("document_id", "id"), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


@query("join3_scalar_subquery", "SELECT r.id, CAST((SELECT count(*) FROM rag_chunks c WHERE c.document_id = r.id AND c.content_type = 'table') AS BIGINT) AS tables FROM rag_documents r")
def _(spark, d):
    table(spark, d, "rag_documents").createOrReplaceTempView("v_rag_documents")
    table(spark, d, "rag_chunks").createOrReplaceTempView("v_rag_chunks")
    return spark.sql("SELECT r.id, (SELECT count(*) FROM v_rag_chunks c WHERE c.document_id = r.id AND c.content_type = 'table') AS tables FROM v_rag_documents r")


@query("join4_exists_in_array", r"SELECT id FROM rag_documents WHERE len(list_filter(authors, lambda x: regexp_matches(x, '(?i)\bvar'))) > 0")
def _(spark, d):
    return table(spark, d, "rag_documents").where(F.exists("authors", lambda a: a.rlike(r"(?i)\bvar"))).select("id")


@query("join5_document_frequency", "WITH q AS (SELECT unnest(['crown', 'sealant', 'bridge']) AS term), t AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM rag_chunks) SELECT term, CAST(count(*) AS BIGINT) AS n FROM t JOIN q USING (term) GROUP BY 1")
def _(spark, d):
    words = ["crown", "sealant", "bridge"]
    hit = F.array_intersect(X.tokens_alnum("content"), F.array(*map(F.lit, words)))
    return table(spark, d, "rag_chunks").select(F.explode(hit).alias("term")).groupBy("term").agg(N())


@query("join6_posting_lookup", "WITH t AS (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM rag_chunks) SELECT term, id, CAST(count(*) AS BIGINT) AS tf FROM t WHERE term IN ('crown', 'sealant') GROUP BY ALL")
def _(spark, d):
    q = spark.createDataFrame([("crown",), ("sealant",)], "term string")
    flat = table(spark, d, "rag_chunks").select("id", F.explode(X.tokens_alnum("content")).alias("term"))
    return flat.join(F.broadcast(q), "term").groupBy("term", "id").agg(F.count("*").alias("tf"))


@query("join7_with_statistics", "SELECT id, round(length(content) / (SELECT avg(length(content)) FROM rag_chunks), 6) AS relative FROM rag_chunks WHERE content IS NOT NULL")
def _(spark, d):
    c = table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.length("content").alias("l"))
    return c.crossJoin(F.broadcast(c.agg(F.avg("l").alias("m")))).select("id", F.round(F.col("l") / F.col("m"), 6).alias("relative"))  # statistics are one row


@query("join8_parent_expansion", "WITH h AS (SELECT document_id, max(length(content)) AS best FROM rag_chunks WHERE contains(lower(content), 'hearing test') GROUP BY 1) SELECT h.document_id, r.title, CAST(best AS BIGINT) AS best FROM h JOIN rag_documents r ON r.id = h.document_id")
def _(spark, d):
    h = table(spark, d, "rag_chunks").where(F.lower("content").contains("hearing test")).groupBy("document_id").agg(F.max(F.length("content")).cast("bigint").alias("best"))
    return h.join(table(spark, d, "rag_documents").select(F.col("id").alias("document_id"), "title"), "document_id").select("document_id", "title", "best")


@query("join9_any_filter", "SELECT id FROM rag_documents WHERE source = ANY(['upload', 'fee-desk'])")
def _(spark, d):
    return table(spark, d, "rag_documents").where(F.col("source").isin("upload", "fee-desk")).select("id")


@query("join10_anti_membership", "SELECT r.id FROM rag_documents r WHERE NOT EXISTS (SELECT 1 FROM rag_chunks c WHERE c.document_id = r.id AND c.content_type = 'figure')")
def _(spark, d):
    fig = table(spark, d, "rag_chunks").where("content_type = 'figure'").select(F.col("document_id").alias("id"))
    return table(spark, d, "rag_documents").select("id").join(fig, "id", "left_anti")


@query("join11_dimension_lookup", "SELECT p_type, r_name, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE contains(lower(p_type), 'e') GROUP BY ALL")
def _(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("part").where(F.lower("p_type").contains("e")), F.col("p_partkey") == F.col("l_partkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return j.join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy("p_type", "r_name").agg(N())


_ALIASES = [("full denture", "denture"), ("denture", "denture"), ("bone density scan", "scan"), ("cardiac scan", "heart"), ("scan", "scan"), ("hearing test", "hearing")]


@query("join12_longest_alias", "WITH a AS (SELECT unnest(['full denture', 'denture', 'bone density scan', 'cardiac scan', 'scan', 'hearing test']) AS alias, unnest(['denture', 'denture', 'scan', 'heart', 'scan', 'hearing']) AS name), m AS (SELECT item_id, alias, name, row_number() OVER (PARTITION BY item_id ORDER BY length(alias) DESC, alias) AS r FROM eval_items, a WHERE contains(' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || alias || ' ')) SELECT item_id, alias, name FROM m WHERE r = 1")
def _(spark, d):
    return R.longest_alias(table(spark, d, "eval_items"), "item_id", "question", _ALIASES)


@query("join13_range_lookup", "WITH z AS (SELECT unnest([0, 300, 700]) AS lo, unnest([199, 499, 899]) AS hi, unnest(['A', 'B', 'C']) AS code) SELECT c_custkey, coalesce(code, 'rest') AS code FROM customer LEFT JOIN z ON c_custkey % 1000 BETWEEN lo AND hi")
def _(spark, d):
    ranges = spark.createDataFrame([(0, 199, "A"), (300, 499, "B"), (700, 899, "C")], "lo long, hi long, code string")
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 1000).alias("zip3"))
    return R.range_lookup(c, "zip3", ranges, "code", 100).select("c_custkey", F.coalesce("code", F.lit("rest")).alias("code"))


@query("join14_composite_lookup", "SELECT o_orderstatus, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN [10, 20, 30] ELSE [5, 6, 7] END[1 + o_orderkey % 3] AS premium, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    rates = spark.createDataFrame([("F", [10, 20, 30]), ("O", [5, 6, 7]), ("P", [5, 6, 7])], "o_orderstatus string, rates array<int>")
    o = table(spark, d, "orders").join(F.broadcast(rates), "o_orderstatus")
    return o.groupBy("o_orderstatus", "o_orderpriority", F.element_at("rates", (1 + F.col("o_orderkey") % 3).cast("int")).alias("premium")).agg(N())


@query("join21_metadata_carry_over", "WITH o AS (SELECT document_id, content_type, page_number, max(image) AS image FROM rag_chunks WHERE image IS NOT NULL GROUP BY ALL) SELECT c.id, coalesce(c.image, o.image) AS image FROM rag_chunks c LEFT JOIN o USING (document_id, content_type, page_number) WHERE c.content_type = 'figure'")
def _(spark, d):
    c = table(spark, d, "rag_chunks")
    o = c.where("image IS NOT NULL").groupBy("document_id", "content_type", "page_number").agg(F.max("image").alias("old"))
    return c.where("content_type = 'figure'").join(o, ["document_id", "content_type", "page_number"], "left").select("id", F.coalesce("image", "old").alias("image"))


@query("join22_incremental_reuse", "SELECT CASE WHEN p.chunk_id IS NULL THEN 'new' WHEN p.h = sha256(c.text) THEN 'reused' ELSE 'changed' END AS state, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT chunk_id, text, plan_year FROM chunk_records) c LEFT JOIN (SELECT chunk_id, sha256(max(text)) AS h FROM chunk_records WHERE plan_year < 2025 GROUP BY 1) p USING (chunk_id) GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "chunk_records")
    old = c.where("plan_year < 2025").groupBy("chunk_id").agg(F.sha2(F.max("text"), 256).alias("h"))
    j = c.select("chunk_id", "text", "plan_year").distinct().join(old, "chunk_id", "left")
    return j.groupBy(F.when(F.col("h").isNull(), "new").when(F.col("h") == F.sha2("text", 256), "reused").otherwise("changed").alias("state")).agg(N())


@query("join23_latest_state", "WITH s AS (SELECT document_id, arg_max(run_id, (created_at, run_id)) AS run_id FROM document_stats GROUP BY 1) SELECT document, run_id, CASE WHEN run_id IS NULL THEN 'not_processed' WHEN title IS NULL THEN 'failed' ELSE 'processed' END AS status FROM demo_documents LEFT JOIN s ON document_id = document")
def _(spark, d):
    s = table(spark, d, "document_stats").groupBy(F.col("document_id").alias("document")).agg(F.max_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))
    status = F.when(F.col("run_id").isNull(), "not_processed").when(F.col("title").isNull(), "failed").otherwise("processed")
    return table(spark, d, "demo_documents").join(s, "document", "left").select("document", "run_id", status.alias("status"))


@query("join24_url_fallback", "SELECT d.document, coalesce(a.document_id, b.document_id) AS matched FROM demo_documents d LEFT JOIN (SELECT DISTINCT document_id FROM document_stats) a ON a.document_id = d.document LEFT JOIN (SELECT DISTINCT document_id FROM chunk_records) b ON b.document_id || '.pdf' = d.filename")
def _(spark, d):
    a = table(spark, d, "document_stats").select(F.col("document_id").alias("document"), F.col("document_id").alias("x")).distinct()
    b = table(spark, d, "chunk_records").select(F.concat("document_id", F.lit(".pdf")).alias("filename"), F.col("document_id").alias("y")).distinct()
    return table(spark, d, "demo_documents").join(a, "document", "left").join(b, "filename", "left").select("document", F.coalesce("x", "y").alias("matched"))


@query("join25_as_of", "WITH p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view') SELECT p.event_id, v.value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts")
def _(spark, d):
    e = table(spark, d, "events")
    return R.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'view'").select("user_id", "ts", "value"), "user_id", "ts", "value").select("event_id", "value")


@query("join26_fuzzy_title", "WITH t AS (SELECT source, id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM rag_documents WHERE title IS NOT NULL), m AS (SELECT a.id, b.id AS other, len(list_intersect(a.w, b.w)) / greatest(len(a.w), 1) AS s FROM t a JOIN t b ON a.source = b.source AND a.id <> b.id) SELECT id, arg_min(other, (-round(s, 6), other)) AS other, round(max(s), 6) AS share FROM m WHERE s >= 0.5 GROUP BY 1")
def _(spark, d):
    return R.fuzzy_match(table(spark, d, "rag_documents"), "id", "title", "source", 0.5)


@query("join27_neighbours", "SELECT id, lag(content_type) OVER w AS before, lead(content_type) OVER w AS after FROM rag_chunks WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, id)")
def _(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", "content_type")
    return G.beside(c, "document_id", "chunk_index", "id", F.col("content_type"), "before", "after").select("id", "before", "after")


@query("join28_provenance", "SELECT chunk_id, CASE WHEN contextualized_text = text THEN 'equal' WHEN contains(contextualized_text, text) THEN 'contained' ELSE 'apart' END AS kind, CAST(count(*) AS BIGINT) AS n FROM chunk_records WHERE contextualized_text IS NOT NULL GROUP BY ALL")
def _(spark, d):
    c, t = F.col("contextualized_text"), F.col("text")
    kind = F.when(c == t, "equal").when(c.contains(t), "contained").otherwise("apart")
    return table(spark, d, "chunk_records").where(c.isNotNull()).groupBy("chunk_id", kind.alias("kind")).agg(N())


@query("join29_plan_documents", "SELECT DISTINCT coalesce(primary_category, 'all') AS plan, id FROM rag_documents WHERE primary_category IN ('vision', 'pharmacy') OR primary_category IS NULL ORDER BY 1, 2")
def _(spark, d):
    plan = F.coalesce("primary_category", F.lit("all"))
    return table(spark, d, "rag_documents").where(F.col("primary_category").isin("vision", "pharmacy") | F.col("primary_category").isNull()).select(plan.alias("plan"), "id").distinct()


@query("join20_band_join", "SELECT a.id AS a, b.id AS b FROM (SELECT id, sha1(content) AS h FROM rag_chunks WHERE content IS NOT NULL) a JOIN (SELECT id, sha1(content) AS h FROM rag_chunks WHERE content IS NOT NULL) b ON a.h = b.h AND a.id = (SELECT min(id) FROM rag_chunks c WHERE sha1(c.content) = a.h) AND a.id < b.id")
def _(spark, d):
    h = table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.sha1("content").alias("h"))
    first = h.groupBy("h").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")  # a star to the first, not all pairs
    return h.join(first, "h").where("id > a").select("a", F.col("id").alias("b"))


@query("win1_top_per_group", "SELECT document_id, id FROM (SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY length(content) DESC, id) AS r FROM rag_chunks WHERE content IS NOT NULL) WHERE r <= 3")
def _(spark, d):
    w = Window.partitionBy("document_id").orderBy(F.desc(F.length("content")), "id")
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 3").select("document_id", "id")


@query("win2_global_rank", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders ORDER BY 2 LIMIT 100")
def _(spark, d):
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("bigint").alias("rank"))


@query("win6_carry_forward", "SELECT id, last_value(page_number IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page FROM rag_chunks")
def _(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", "page_number")
    return G.running_last(c, "document_id", "chunk_index", "id", F.col("page_number"), "page").select("id", "page")


@query("win8_fill_both_ways", "SELECT id, coalesce(last_value(page_number IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(page_number IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS page FROM rag_chunks")
def _(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", "page_number")
    c = G.running_last(c, "document_id", "chunk_index", "id", F.col("page_number"), "down")
    return G.running_last(c, "document_id", "chunk_index", "id", F.col("page_number"), "up", ahead=True).select("id", F.coalesce("down", "up").alias("page"))


@query("win9_fragments", "WITH m AS (SELECT id, document_id, chunk_index, content_type, sum(CASE WHEN content_type IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS island FROM (SELECT *, lag(content_type) OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS p FROM rag_chunks)) SELECT document_id, CAST(island AS BIGINT) AS island, any_value(content_type) AS content_type, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY document_id, island")
def _(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", "content_type")
    c = G.beside(c, "document_id", "chunk_index", "id", F.col("content_type"), "before", "after")
    # a document's first chunk without a type continues nothing either, as its missing predecessor has none
    c = G.running_sum(c, "document_id", "chunk_index", "id", (~F.col("content_type").eqNullSafe(F.col("before"))).cast("int"), "island")
    return c.groupBy("document_id", "island").agg(F.max("content_type").alias("content_type"), N())


@query("win10_first_occurrence", "SELECT code, arg_min(id, id) AS id FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '\\bD[0-9]{4}\\b'))) AS code FROM rag_chunks) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "rag_chunks").select("id", F.explode(X.found("content", r"\bD[0-9]{4}\b")).alias("code")).groupBy("code").agg(F.min("id").alias("id"))


@query("win11_ordered_dedup", "WITH f AS (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1) SELECT event_type, CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS rank FROM f")
def _(spark, d):
    f = table(spark, d, "events").groupBy("event_type").agg(F.min("event_id").alias("first"))
    return f.select("event_type", F.row_number().over(Window.orderBy("first")).cast("bigint").alias("rank"))


@query("win13_common_prefix", "WITH t AS (SELECT item_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS q, regexp_extract_all(lower(passage), '[a-z0-9]+') AS p FROM eval_items) SELECT item_id, CAST(len(list_filter(range(1, least(len(q), len(p)) + 1), lambda i: q[1:i] = p[1:i])) AS BIGINT) AS prefix FROM t")
def _(spark, d):
    e = table(spark, d, "eval_items").select("item_id", F.arrays_zip(X.tokens_alnum("question").alias("q"), X.tokens_alnum("passage").alias("p")).alias("z"))
    count = F.aggregate("z", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s.n + F.when(s.go & x["q"].eqNullSafe(x["p"]), 1).otherwise(0)).alias("n"), (s.go & x["q"].eqNullSafe(x["p"])).alias("go")), lambda s: s.n)
    return e.select("item_id", count.alias("prefix"))


@query("win14_cumulative_cost", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("spent"))


def _sort(name: str, sql: str, fn) -> None:
    query(name, sql)(fn)


_sort("sort1_order_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20", lambda s, d: table(s, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey"))
_sort("sort3_tie_breaks", "SELECT id FROM rag_chunks WHERE content IS NOT NULL ORDER BY length(content) DESC, document_id, chunk_index LIMIT 20", lambda s, d: table(s, d, "rag_chunks").where("content IS NOT NULL").orderBy(F.desc(F.length("content")), "document_id", "chunk_index").limit(20).select("id"))
_sort("sort4_stable_top", "SELECT event_id FROM events ORDER BY round(value) DESC, event_id LIMIT 20", lambda s, d: table(s, d, "events").orderBy(F.desc(F.round("value")), "event_id").limit(20).select("event_id"))
_sort("sort5_case_order", "SELECT o_orderkey FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderkey LIMIT 20", lambda s, d: table(s, d, "orders").orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), "o_orderkey").limit(20).select("o_orderkey"))
_sort("sort6_priority_tuple", "SELECT id FROM rag_chunks ORDER BY CASE content_type WHEN 'table' THEN 0 WHEN 'figure' THEN 1 ELSE 2 END, document_id, chunk_index LIMIT 20", lambda s, d: table(s, d, "rag_chunks").orderBy(F.when(F.col("content_type") == "table", 0).when(F.col("content_type") == "figure", 1).otherwise(2), "document_id", "chunk_index").limit(20).select("id"))
_sort("sort7_most_common", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 ORDER BY 2 DESC, min(c_custkey) LIMIT 3", lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(N(), F.min("c_custkey").alias("f")).orderBy(F.desc("n"), "f").limit(3).select("c_mktsegment", "n"))
_sort("sort9_closest_to_half", "SELECT event_id FROM events ORDER BY abs(value / 100 - 0.5), event_id LIMIT 15", lambda s, d: table(s, d, "events").orderBy(F.abs(F.col("value") / 100 - 0.5), "event_id").limit(15).select("event_id"))


@query("setop1_union_of_candidates", "SELECT id FROM rag_chunks WHERE contains(content, 'crown') UNION SELECT id FROM rag_chunks WHERE contains(content, 'sealant')")
def _(spark, d):
    c = table(spark, d, "rag_chunks")
    hit = lambda w: c.where(F.col("content").contains(w)).select("id")
    return hit("crown").unionByName(hit("sealant")).distinct()


@query("setop2_3_array_sets", "SELECT id, CAST(len(list_intersect(list_distinct(categories), ['vision', 'claims'])) AS BIGINT) AS common, CAST(len(list_filter(list_distinct(categories), lambda x: x NOT IN ('vision', 'claims'))) AS BIGINT) AS extra FROM rag_documents WHERE categories IS NOT NULL")
def _(spark, d):
    want = F.array(F.lit("vision"), F.lit("claims"))
    return table(spark, d, "rag_documents").where("categories IS NOT NULL").select("id", F.size(F.array_intersect("categories", want)).cast("bigint").alias("common"), F.size(F.array_except("categories", want)).cast("bigint").alias("extra"))


@query("setop4_disjoint_splits", "SELECT CAST((SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 1)) AS BIGINT) AS shared")
def _(spark, d):
    o = table(spark, d, "orders")
    part = lambda k: o.where(F.col("o_orderkey") % 10 == k).select("o_custkey")
    return part(0).intersect(part(1)).agg(F.count("*").alias("shared"))


@query("setop5_concat", "SELECT content_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT content_type FROM rag_chunks UNION ALL SELECT content_type FROM chunk_records) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "rag_chunks").select("content_type").unionByName(table(spark, d, "chunk_records").select("content_type", "plan_year"), allowMissingColumns=True).groupBy("content_type").agg(N())


@query("setop6_ordered_dedup", "SELECT id, array_to_string(list_filter(categories, lambda x, i: list_position(categories, x) = i), ',') AS kept FROM rag_documents WHERE categories IS NOT NULL")
def _(spark, d):
    return table(spark, d, "rag_documents").where("categories IS NOT NULL").select("id", F.array_join(F.array_distinct("categories"), ",").alias("kept"))


@query("setop7_distinct_texts", "SELECT min(id) AS id FROM rag_chunks WHERE content IS NOT NULL GROUP BY content")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").groupBy(F.sha2("content", 256).alias("h"), F.length("content").alias("l")).agg(F.min("id").alias("id")).select("id")


@query("setop8_select_distinct", "SELECT DISTINCT source FROM rag_documents")
def _(spark, d):
    return table(spark, d, "rag_documents").select("source").distinct()


@query("agg14_15_max_per_owner", "SELECT document_id, CAST(max(length(content)) AS BIGINT) AS best FROM rag_chunks GROUP BY 1")
def _(spark, d):
    return table(spark, d, "rag_chunks").groupBy("document_id").agg(F.max(F.length("content")).cast("bigint").alias("best"))


@query("agg16_distinct_counts", "SELECT CAST(count(DISTINCT document_id) AS BIGINT) AS documents, CAST(count(*) AS BIGINT) AS chunks FROM rag_chunks")
def _(spark, d):
    return table(spark, d, "rag_chunks").agg(F.count_distinct("document_id").alias("documents"), F.count("*").alias("chunks"))


@query("agg17_ordered_lists", "WITH k AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS types FROM k GROUP BY 1")
def _(spark, d):
    k = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return k.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda s: s.event_type), ",").alias("types"))


@query("agg18_cost_by_category", "SELECT p_type, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS cost FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy("p_type").agg(N(), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@query("agg19_histograms", "SELECT 'category' AS kind, coalesce(primary_category, 'unknown') AS label, CAST(count(*) AS BIGINT) AS n FROM rag_documents GROUP BY 2 UNION ALL SELECT 'tag', c, count(*) FROM (SELECT unnest(categories) AS c FROM rag_documents) GROUP BY 2")
def _(spark, d):
    r = table(spark, d, "rag_documents")
    a = r.groupBy(F.coalesce("primary_category", F.lit("unknown")).alias("label")).agg(N()).select(F.lit("category").alias("kind"), "label", "n")
    return a.unionByName(r.select(F.explode("categories").alias("label")).groupBy("label").agg(N()).select(F.lit("tag").alias("kind"), "label", "n"))


@query("agg20_status_counts", "SELECT review_status, CAST(count(*) AS BIGINT) AS n FROM chunk_records GROUP BY 1")
def _(spark, d):
    return table(spark, d, "chunk_records").groupBy("review_status").agg(N())


@query("agg21_conditional_counts", "SELECT CAST(count(*) FILTER (review_status = 'approved') AS BIGINT) AS approved, CAST(count(*) FILTER (review_status = 'rejected') AS BIGINT) AS rejected FROM chunk_records")
def _(spark, d):
    return table(spark, d, "chunk_records").agg(F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if(F.col("review_status") == "rejected").alias("rejected"))


@query("agg29_leakage_checks", "SELECT CAST(count(*) AS BIGINT) AS shared_ids FROM (SELECT document_id FROM chunk_records WHERE plan_year = 2024 INTERSECT SELECT document_id FROM chunk_records WHERE plan_year = 2025)")
def _(spark, d):
    c = table(spark, d, "chunk_records")
    ids = lambda y: c.where(F.col("plan_year") == y).select("document_id")
    return ids(2024).intersect(ids(2025)).agg(F.count("*").alias("shared_ids"))


@query("scan3_validated_chunks", "SELECT chunk_id FROM chunk_records WHERE length(contextualized_text) >= 100 GROUP BY 1")
def _(spark, d):
    return table(spark, d, "chunk_records").where(F.length("contextualized_text") >= 100).select("chunk_id").distinct()


@query("scan5_newest_run", "SELECT document_id, arg_max(run_id, (created_at, run_id)) AS run_id FROM document_stats GROUP BY 1")
def _(spark, d):
    return R.latest(table(spark, d, "document_stats"), ["document_id"], ["created_at", "run_id"]).select("document_id", "run_id")


@query("scan6_list_runs", "SELECT DISTINCT run_id, created_at FROM document_stats ORDER BY created_at DESC, run_id DESC")
def _(spark, d):
    return table(spark, d, "document_stats").select("run_id", "created_at").distinct()


@query("scan7_inventory", "WITH a AS (SELECT DISTINCT document AS id FROM demo_documents), b AS (SELECT DISTINCT document_id AS id FROM document_stats) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'processed_only' WHEN b.id IS NULL THEN 'raw_only' ELSE 'both' END AS status FROM a FULL JOIN b ON a.id = b.id")
def _(spark, d):
    a = table(spark, d, "demo_documents").select(F.col("document").alias("id"), F.lit(1).alias("a")).distinct()
    b = table(spark, d, "document_stats").select(F.col("document_id").alias("id"), F.lit(1).alias("b")).distinct()
    return a.join(b, "id", "full_outer").select("id", F.when(F.col("a").isNull(), "processed_only").when(F.col("b").isNull(), "raw_only").otherwise("both").alias("status"))


@query("scan12_preferred_source", "SELECT document_id, page_number, arg_min(id, (CASE content_type WHEN 'table' THEN 0 WHEN 'figure' THEN 1 ELSE 2 END, id)) AS id FROM rag_chunks WHERE page_number IS NOT NULL GROUP BY ALL")
def _(spark, d):
    rank = F.when(F.col("content_type") == "table", 0).when(F.col("content_type") == "figure", 1).otherwise(2)
    return table(spark, d, "rag_chunks").where("page_number IS NOT NULL").groupBy("document_id", "page_number").agg(F.min_by("id", F.struct(rank, "id")).alias("id"))


@query("scan23_chunks_of_document", "SELECT id, chunk_index FROM rag_chunks WHERE document_id = 'fee-schedule-master'")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("document_id = 'fee-schedule-master'").select("id", "chunk_index")


@query("scan25_event_offsets", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 40")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("seq", F.row_number().over(w)).where("seq > 40").select("user_id", "event_id")


@query("sink6_upsert_documents", "SELECT id, coalesce(title, 'kept') AS title FROM rag_documents")
def _(spark, d):
    old = table(spark, d, "rag_documents").select("id", F.lit("kept").alias("title"))
    return R.upsert(old, table(spark, d, "rag_documents").select("id", "title"), ["id"])


@query("sink9_pruned_rows", "SELECT c.id FROM rag_chunks c WHERE c.document_id IN (SELECT id FROM rag_documents WHERE source = 'upload')")
def _(spark, d):
    keep = table(spark, d, "rag_documents").where("source = 'upload'").select(F.col("id").alias("document_id"))
    return table(spark, d, "rag_chunks").select("id", "document_id").join(keep, "document_id", "left_semi").select("id")


@query("sink13_inverted_index", "SELECT lexeme, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(tf) AS BIGINT) AS uses FROM (SELECT id, lexeme, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS lexeme FROM rag_chunks) GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "rag_chunks").select("id", F.explode(X.tokens_alnum("content")).alias("lexeme")).groupBy("id", "lexeme").agg(F.count("*").alias("tf"))
    return p.groupBy("lexeme").agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"))


@query("sink14_15_generated_columns", "SELECT id, CAST(length(content) AS BIGINT) AS content_len, CASE WHEN image IS NOT NULL THEN 'figure' ELSE coalesce(content_type, 'text') END AS content_type FROM rag_chunks")
def _(spark, d):
    return table(spark, d, "rag_chunks").select("id", F.length("content").cast("bigint").alias("content_len"), F.when(F.col("image").isNotNull(), "figure").otherwise(F.coalesce("content_type", F.lit("text"))).alias("content_type"))


@query("sink17_event_sequence", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("seq"))


@query("sink19_promotion_gate", "SELECT document_id, min(CAST(review_status = 'approved' AS INTEGER)) = 1 AS promoted FROM (SELECT chunk_id, document_id, arg_max(coalesce(review_status, 'pending'), (coalesce(contextualized_at, TIMESTAMP '1970-01-01'), coalesce(review_status, 'pending'))) AS review_status FROM chunk_records GROUP BY ALL) GROUP BY 1")
def _(spark, d):
    s = F.coalesce("review_status", F.lit("pending"))
    c = table(spark, d, "chunk_records").groupBy("chunk_id", "document_id").agg(F.max_by(s, F.struct(F.coalesce("contextualized_at", F.lit("1970-01-01").cast("timestamp")), s)).alias("s"))
    return c.groupBy("document_id").agg((F.min((F.col("s") == "approved").cast("int")) == 1).alias("promoted"))
