"""Queries that cut texts and reshape tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexa.operators import chunks as C
from codexa.operators import ranges as G
from codexa.plans.registry import query
from codexa.sources.tables import table

_W = "w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)"


@query("chk1_word_windows", f"WITH {_W} SELECT doc_id, CAST(i // 300 AS BIGINT) AS piece, array_to_string(w[i + 1 : i + 350], ' ') AS win FROM (SELECT doc_id, w, unnest(range(0, len(w), 300)) AS i FROM w)")
def _(spark, d):
    return C.windows(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.col("window").alias("win"))


@query("chk2_page_windows", "WITH w AS (SELECT document_id, coalesce(page_number, 0) AS page, chunk_index, id, list_filter(string_split(trim(regexp_replace(content, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM rag_chunks WHERE content IS NOT NULL), u AS (SELECT document_id, page, chunk_index, id, unnest(range(0, len(w), 90)) AS i FROM w) SELECT id, CAST(i // 90 AS BIGINT) AS piece, CAST(row_number() OVER (PARTITION BY document_id ORDER BY page, chunk_index, id, i) - 1 AS BIGINT) AS new_index FROM u")
def _(spark, d):
    c = table(spark, d, "rag_chunks")
    p = C.windows(c, "id", "content", 100, 10).select("id", F.col("piece").cast("bigint").alias("piece"))
    w = Window.partitionBy("document_id").orderBy(F.coalesce("page_number", F.lit(0)), "chunk_index", "id", "piece")
    return p.join(c.select("id", "document_id", "page_number", "chunk_index"), "id").select("id", "piece", (F.row_number().over(w) - 1).cast("bigint").alias("new_index"))


@query("chk3_packed_paragraphs")
def _(spark, d):
    return C.packed_paragraphs(table(spark, d, "documents"), "doc_id", "text")


@query("chk4_table_parts")
def _(spark, d):
    t = table(spark, d, "chunk_records").where("content_type = 'table_row'").select("chunk_id", "text").distinct()
    return C.table_pieces(t, "chunk_id", "text", 400)


@query("chk5_recursive_pieces")
def _(spark, d):
    return C.recursive_pieces(table(spark, d, "documents"), "doc_id", "text")


@query("chk6_content_ids", "SELECT DISTINCT chunk_id, sha256(coalesce(section, '') || chr(10) || text) AS content_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM chunk_records")
def _(spark, d):
    c = table(spark, d, "chunk_records")
    return c.select("chunk_id", F.sha2(F.concat(F.coalesce("section", F.lit("")), F.lit("\n"), F.col("text")), 256).alias("content_id"), F.ceil(F.length("text") / 4).alias("tokens")).distinct()


@query("chk7_page_interleave", "SELECT id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY coalesce(page_number, 0), CASE WHEN content_type = 'table' THEN 1 ELSE 0 END, chunk_index, id) AS BIGINT) AS place FROM rag_chunks")
def _(spark, d):
    # counted within a page, after the sizes of the pages before it
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", F.coalesce("page_number", F.lit(0)).alias("page"), F.when(F.col("content_type") == "table", 1).otherwise(0).alias("late"))
    before = Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    sizes = c.groupBy("document_id", "page").agg(F.count("*").alias("n")).select("document_id", "page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("document_id", "page").orderBy("late", "chunk_index", "id")
    return c.withColumn("r", F.row_number().over(w)).join(sizes, ["document_id", "page"]).select("id", (F.col("base") + F.col("r")).alias("place"))


@query("chk8_compact_markdown", r"SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(text, ' *\| *', '|', 'g'), '-{3,}', '---', 'g') AS compact FROM chunk_records")
def _(spark, d):
    return table(spark, d, "chunk_records").select("chunk_id", F.regexp_replace(F.regexp_replace("text", r" *\| *", "|"), "-{3,}", "---").alias("compact")).distinct()


@query("chk9_whole_documents", "SELECT document_id, sha256(string_agg('[page ' || coalesce(CAST(page_number AS VARCHAR), '?') || '] ' || content, chr(10) ORDER BY chunk_index, id)) AS digest FROM rag_chunks WHERE content IS NOT NULL GROUP BY 1")
def _(spark, d):
    line = F.concat(F.lit("[page "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit("] "), F.col("content"))
    g = table(spark, d, "rag_chunks").where("content IS NOT NULL").groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", line.alias("t")))).alias("x"))
    return g.select("document_id", F.sha2(F.array_join(F.transform("x", lambda s: s.t), "\n"), 256).alias("digest"))


@query("chk21_document_records", "SELECT document_id, sha256(document_id || ':' || CAST(count(*) AS VARCHAR)) AS record_id, CASE WHEN count(*) FILTER (content_type = 'table') > 0 THEN 'table' ELSE 'text' END AS route FROM rag_chunks GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "rag_chunks").groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("content_type") == "table").alias("t"))
    return g.select("document_id", F.sha2(F.concat("document_id", F.lit(":"), F.col("n").cast("string")), 256).alias("record_id"), F.when(F.col("t") > 0, "table").otherwise("text").alias("route"))


def _cells(spark, d):
    t = table(spark, d, "chunk_records").where("content_type = 'table_row'").select("chunk_id", "text").distinct().where(F.col("text").contains(";"))
    rows = F.transform(F.filter(F.split("text", "\n"), lambda x: x.contains(";")), lambda x: F.split(x, ";"))
    return t.select("chunk_id", rows.alias("rows")).where(F.size("rows") > 0).select("chunk_id", "rows", F.transform(F.sequence(F.lit(0), F.size(F.col("rows")[0]) - 1), lambda i: i.cast("string")).alias("headers"))


_T = "t AS (SELECT chunk_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, ';')), lambda x: string_split(x, ';')) AS rows FROM (SELECT DISTINCT chunk_id, text FROM chunk_records WHERE content_type = 'table_row' AND contains(text, ';'))), tt AS (SELECT * FROM t WHERE len(rows) > 0)"


@query("chk10_default_headers", f"WITH {_T} SELECT chunk_id, true AS numbered FROM tt")
def _(spark, d):
    return _cells(spark, d).select("chunk_id", C.is_default_header(F.col("headers")).alias("numbered"))


@query("chk11_promoted_headers", f"WITH {_T} SELECT chunk_id, CASE WHEN len(rows) > 1 AND len(list_filter(rows[1], lambda x: trim(x) = '')) = 0 AND len(list_distinct(rows[1])) = len(rows[1]) THEN array_to_string(rows[1], '|') ELSE array_to_string(list_transform(range(0, len(rows[1])), lambda i: CAST(i AS VARCHAR)), '|') END AS header FROM tt")
def _(spark, d):
    p = _cells(spark, d).select("chunk_id", C.promoted(F.col("headers"), F.col("rows")).alias("p"))
    return p.select("chunk_id", F.array_join("p.headers", "|").alias("header"))


@query("chk12_normal_tables", f"WITH {_T} SELECT chunk_id, CAST(list_max(list_transform(rows, lambda r: len(r))) AS BIGINT) AS width, CAST(len(rows) AS BIGINT) AS n_rows FROM tt")
def _(spark, d):
    n = _cells(spark, d).select("chunk_id", C.normal_table(F.col("headers"), F.col("rows")).alias("n"))
    return n.select("chunk_id", F.size("n.headers").cast("bigint").alias("width"), F.size(F.filter("n.rows", lambda r: F.size(r) == F.size("n.headers"))).cast("bigint").alias("n_rows"))


@query("chk13_inferred_titles", f"WITH {_T} SELECT chunk_id, CASE WHEN regexp_matches(rows[1][2], '^[A-Z][0-9]{{4}}$') THEN 'Fee schedule' ELSE 'Table' END AS title FROM tt")
def _(spark, d):
    return _cells(spark, d).select("chunk_id", F.when(F.get(F.col("rows")[0], F.lit(1)).rlike("^[A-Z][0-9]{4}$"), "Fee schedule").otherwise("Table").alias("title"))


@query("chk14_section_carry", "SELECT id, last_value(CASE WHEN content_type IS NOT NULL AND content_type <> 'text' THEN content_type END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM rag_chunks")
def _(spark, d):
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", "content_type")
    return G.running_last(c, "document_id", "chunk_index", "id", F.when(F.col("content_type") != "text", F.col("content_type")), "section").select("id", "section")


@query("chk15_source_terms", "WITH u AS (SELECT id, split_part(id, '-', 1) AS term, 1 AS p, 'id' AS kind FROM rag_documents UNION ALL SELECT id, lower(unnest(regexp_extract_all(title, '[A-Z][a-z]{3,}'))), 2, 'title' FROM rag_documents), r AS (SELECT *, row_number() OVER (PARTITION BY id, term ORDER BY p) AS k FROM u WHERE length(term) >= 4) SELECT id, term, kind FROM r WHERE k = 1")
def _(spark, d):
    r = table(spark, d, "rag_documents")
    a = r.select("id", F.split("id", "-")[0].alias("term"), F.lit(1).alias("p"), F.lit("id").alias("kind"))
    b = r.select("id", F.explode(F.regexp_extract_all("title", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("term")).select("id", F.lower("term").alias("term"), F.lit(2).alias("p"), F.lit("title").alias("kind"))
    u = a.unionByName(b).where(F.length("term") >= 4)
    return u.groupBy("id", "term").agg(F.min_by("kind", "p").alias("kind"))


@query("chk17_unpivot", "UNPIVOT (SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS regionkey, CAST(length(n_name) AS BIGINT) AS name_length FROM nation) ON regionkey, name_length INTO NAME measure VALUE value")
def _(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("regionkey"), F.length("n_name").cast("bigint").alias("name_length"))
    return n.unpivot("n_nationkey", ["regionkey", "name_length"], "measure", "value")


@query("chk19_labelled_fields", r"SELECT DISTINCT chunk_id, regexp_extract(text, 'control number ([0-9-]+)', 1) AS control, regexp_extract(text, 'revision ([0-9]+)', 1) AS revision FROM chunk_records WHERE contains(text, 'control number')")
def _(spark, d):
    c = table(spark, d, "chunk_records").where(F.col("text").contains("control number"))
    return c.select("chunk_id", F.regexp_extract("text", "control number ([0-9-]+)", 1).alias("control"), F.regexp_extract("text", "revision ([0-9]+)", 1).alias("revision")).distinct()


@query("chk20_cross_field_rules", "SELECT o_orderkey, abs(o_totalprice - sum(l_extendedprice * (1 + l_tax) * (1 - l_discount))) < 1 AS adds_up FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice")
def _(spark, d):
    total = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))).alias("t"))
    return table(spark, d, "orders").join(total, "o_orderkey").select("o_orderkey", (F.abs(F.col("o_totalprice") - F.col("t")) < 1).alias("adds_up"))


@query("chk6_merged_peers", """WITH RECURSIVE c AS (SELECT DISTINCT chunk_id, document_id, coalesce(section, '') AS section, text FROM chunk_records WHERE text IS NOT NULL), e AS (SELECT document_id, section, text, CAST((length(text) + 3) // 4 AS INTEGER) AS t, row_number() OVER (PARTITION BY document_id, section ORDER BY chunk_id) AS i FROM c),
r AS (SELECT document_id, section, i, 0 AS piece, t AS acc, t FROM e WHERE i = 1 UNION ALL SELECT e.document_id, e.section, e.i, CASE WHEN r.acc + e.t <= 256 THEN r.piece ELSE r.piece + 1 END, CASE WHEN r.acc + e.t <= 256 THEN r.acc + e.t ELSE e.t END, e.t FROM r JOIN e ON e.document_id = r.document_id AND e.section = r.section AND e.i = r.i + 1)
SELECT document_id, section, piece, CAST(count(*) AS INTEGER) AS chunks, CAST(sum(t) AS INTEGER) AS tokens FROM r GROUP BY ALL""")
def _(spark, d):
    c = table(spark, d, "chunk_records").where("text IS NOT NULL").select("chunk_id", "document_id", F.coalesce("section", F.lit("")).alias("section"), "text").distinct()
    return C.merged_peers(c, "chunk_id", ["document_id", "section"], "text").select("document_id", "section", "piece", "chunks", "tokens")
