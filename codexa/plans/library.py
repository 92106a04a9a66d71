"""Queries of library search, matching, tables in pieces, mirrors and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.operators import guards, learned, ranges
from codexa.operators import library as L
from codexa.plans.registry import query
from codexa.sources import files
from codexa.sources.tables import table

N = lambda: F.count("*").alias("n")


@query("proj1_approved", "SELECT DISTINCT chunk_id FROM chunk_records WHERE lower(review_status) IN ('approved', 'passed')")
def _(spark, d):
    return L.approved(table(spark, d, "chunk_records")).select("chunk_id").distinct()


@query("proj2_conjunctive", "SELECT id FROM rag_documents WHERE published >= DATE '2022-01-01' AND published < DATE '2025-01-01' AND (primary_category = 'vision' OR list_contains(categories, 'vision')) AND len([a for a in authors if contains(lower(a), 'mont')]) > 0")
def _(spark, d):
    return L.find_documents(table(spark, d, "rag_documents"), author="Mont", year_from=2022, year_to=2024, category="vision").select("id")


@query("proj3_title_contains", "SELECT id FROM rag_documents WHERE title ILIKE '%sealant%'")
def _(spark, d):
    return L.find_documents(table(spark, d, "rag_documents"), title_contains="SEALANT").select("id")


@query("proj4_in_array", "SELECT id FROM rag_documents WHERE primary_category = 'claims' OR 'claims' = ANY(categories)")
def _(spark, d):
    return L.find_documents(table(spark, d, "rag_documents"), category="claims").select("id")


_CLUSTERS = "g AS (SELECT md5(content) AS cluster, count(*) AS size, list_distinct(list(coalesce(content_type, 'text'))) AS kinds, count(DISTINCT document_id) AS owners, min(lower(content)) AS title FROM rag_chunks WHERE content IS NOT NULL GROUP BY 1)"


@query("proj25_filtered_clusters", f"WITH {_CLUSTERS} SELECT cluster, CAST(size AS BIGINT) AS size FROM g WHERE size >= 2 AND owners > 1 AND list_has_any(kinds, ['text', 'table'])")
def _(spark, d):
    c = table(spark, d, "rag_chunks").where("content IS NOT NULL").groupBy(F.md5("content").alias("cluster"))
    # a cluster keeps two owners at most, which is all the filter asks
    two = F.array_distinct(F.array(F.min("document_id"), F.max("document_id")))
    c = c.agg(F.count("*").alias("size"), F.collect_set(F.coalesce("content_type", F.lit("text"))).alias("kinds"), two.alias("owners"), F.min(F.lower("content")).alias("title"))
    return L.filter_clusters(c, 2, kinds=["text", "table"], one_owner=False).select("cluster", "size")


_ROWS = r"r AS (SELECT DISTINCT chunk_id, unnest(string_split(text, chr(10))) AS line FROM chunk_records WHERE content_type = 'table_row')"


def _rows(spark, d):
    return table(spark, d, "chunk_records").where("content_type = 'table_row'").select("chunk_id", F.explode(F.split("text", "\n")).alias("line")).distinct()


@query("proj29_relation_rows", rf"WITH {_ROWS} SELECT chunk_id, regexp_extract(line, '[A-Z][0-9]{{4}}', 0) AS code, regexp_extract(line, '[$][0-9,.]+', 0) AS amount FROM r WHERE regexp_matches(lower(line), '\bsealant\b') AND regexp_matches(line, '[A-Z][0-9]{{4}}')")
def _(spark, d):
    r = _rows(spark, d).where(F.lower("line").rlike(r"\bsealant\b") & F.col("line").rlike("[A-Z][0-9]{4}"))
    return r.select("chunk_id", F.regexp_extract("line", "[A-Z][0-9]{4}", 0).alias("code"), F.regexp_extract("line", "[$][0-9,.]+", 0).alias("amount"))


@query("proj30_marked_names", rf"WITH {_ROWS} SELECT chunk_id, array_to_string(list_sort(list_distinct(list(regexp_extract(line, '[A-Z][0-9]{{4}}', 0)))), ',') AS codes FROM r WHERE regexp_matches(line, '[A-Z][0-9]{{4}}') AND regexp_matches(line, '\b80%') GROUP BY 1")
def _(spark, d):
    r = table(spark, d, "chunk_records").where("content_type = 'table_row'").select("chunk_id", F.split("text", "\n").alias("lines")).distinct()
    some = F.transform(F.filter("lines", lambda x: x.rlike("[A-Z][0-9]{4}") & x.rlike(r"\b80%")), lambda x: F.regexp_extract(x, "[A-Z][0-9]{4}", 0))
    return r.select("chunk_id", F.array_join(F.array_sort(F.array_distinct(some)), ",").alias("codes")).where("codes <> ''")


@query("proj31_bullets", r"SELECT DISTINCT chunk_id, array_to_string([trim(substring(trim(x), 2)) for x in string_split(text, chr(10)) if regexp_matches(x, '^\s*[-•*] ')], '; ') AS bullets FROM chunk_records WHERE text IS NOT NULL AND section IS NOT NULL AND regexp_matches(text, '(?m)^\s*[-•*] ')")
def _(spark, d):
    """Bullets under a heading, the heading being the chunk's section."""
    c = table(spark, d, "chunk_records").where(F.col("section").isNotNull() & F.col("text").rlike(r"(?m)^\s*[-•*] ")).select("chunk_id", "text").distinct()
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"^\s*[-•*] "))
    return c.select("chunk_id", F.array_join(F.transform(lines, lambda x: F.trim(F.substr(F.trim(x), F.lit(2)))), "; ").alias("bullets"))


@query("proj32_source_summary", "SELECT coalesce(source, 'none') AS source, CAST(count(*) AS BIGINT) AS documents, array_to_string(list_sort(list_distinct(list(primary_category) FILTER (primary_category IS NOT NULL))), ',') AS categories, min(title) AS first_title FROM rag_documents GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "rag_documents").groupBy(F.coalesce("source", F.lit("none")).alias("source"))
    return g.agg(F.count("*").alias("documents"), F.when(F.count("primary_category") > 0, F.array_join(F.array_sort(F.collect_set("primary_category")), ",")).alias("categories"), F.min("title").alias("first_title"))


_WANTED = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


@query("sort2_nearest", f"SELECT id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_WANTED} AS DOUBLE[])), 9) AS distance FROM rag_chunks WHERE len(embedding) = 64 AND document_id = 'fee-schedule-master' AND len([x for x in embedding if x IS NULL OR isnan(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0 ORDER BY 2, 1 LIMIT 10")
def _(spark, d):
    return L.nearest_to(table(spark, d, "rag_chunks"), "embedding", _WANTED, "id", 10, "document_id", ["fee-schedule-master"])


@query("ret29_library_search", r"SELECT item_id, CASE WHEN regexp_matches(lower(question), '\b(?:list|how many|which (?:documents|plans|brochures))\b') THEN 'list' WHEN regexp_matches(lower(question), '\b(?:find|show me|published|titled|by author)\b') THEN 'find' ELSE 'content' END AS kind FROM eval_items WHERE question IS NOT NULL")
def _(spark, d):
    return table(spark, d, "eval_items").where("question IS NOT NULL").select("item_id", L.request_kind("question").alias("kind"))


_ALIAS = [("wound dressing", "wound care"), ("contact lens fitting", "lenses"), ("home nursing visit", "home care"), ("allergy panel", "allergy tests")]
_CONCEPTS = [("tests", [["allergy", "blood", "lab"], ["panel", "test", "allergy panel"]]), ("care", [["nursing", "home nursing", "wound"], ["visit", "dressing"]])]


def _alias_sql() -> str:
    has = lambda p: f"contains(t, ' {p} ')"
    rows = [f"SELECT item_id, '{n}' AS name, {1000 + len(a.split())} AS score FROM q WHERE {has(a)}" for a, n in _ALIAS]
    for n, groups in _CONCEPTS:
        best = [f"greatest({', '.join(f'CASE WHEN {has(p)} THEN {len(p.split())} ELSE 0 END' for p in g)})" for g in groups]
        rows.append(f"SELECT item_id, '{n}', 500 + {' + '.join(best)} FROM q WHERE {' AND '.join(f'{b} > 0' for b in best)}")
    return f"WITH q AS (SELECT item_id, ' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM eval_items), h AS ({' UNION ALL '.join(rows)}) SELECT item_id, arg_min(name, (-score, name)) AS name, CAST(max(score) AS INTEGER) AS score FROM h GROUP BY 1"


@query("ret21_best_alias", _alias_sql())
def _(spark, d):
    return L.best_alias(table(spark, d, "eval_items"), "item_id", "question", _ALIAS, _CONCEPTS)


@query("ret22_matching_sources", "WITH m AS (SELECT id, title, CASE WHEN contains(lower(title), 'sealant') THEN 3 WHEN contains(lower(title), 'hearing') THEN 2 ELSE 1 END AS p, len(string_split(title, ' ')) AS words FROM rag_documents WHERE title IS NOT NULL), r AS (SELECT *, rank() OVER (ORDER BY p DESC, words DESC) AS r FROM m) SELECT id FROM r WHERE r = 1")
def _(spark, d):
    """All sources that share the first place, by priority and then by how many words match."""
    t = F.lower("title")
    m = table(spark, d, "rag_documents").where("title IS NOT NULL").select("id", F.when(t.contains("sealant"), 3).when(t.contains("hearing"), 2).otherwise(1).alias("p"), F.size(F.split("title", " ")).alias("words"))
    best = m.agg(F.max(F.struct("p", "words")).alias("b"))
    return m.join(F.broadcast(best), F.struct("p", "words") == F.col("b")).select("id")


@query("ret23_sections", "WITH s AS (SELECT DISTINCT chunk_id, document_id, section, contains(lower(section), 'rules') AS m FROM chunk_records), a AS (SELECT document_id, bool_or(coalesce(m, false)) AS any_m FROM s GROUP BY 1) SELECT chunk_id FROM s JOIN a USING (document_id) WHERE section IS NULL OR coalesce(m, false) OR NOT any_m")
def _(spark, d):
    """Chunks without a section always; others where their section matches, or where none of the document's does."""
    s = table(spark, d, "chunk_records").select("chunk_id", "document_id", "section", F.coalesce(F.lower("section").contains("rules"), F.lit(False)).alias("m")).distinct()
    met = s.groupBy("document_id").agg(F.max("m").alias("any_m"))
    return s.join(met, "document_id").where("section IS NULL OR m OR NOT any_m").select("chunk_id")


@query("ret24_inventory", "WITH c AS (SELECT DISTINCT unnest(categories) AS name, source FROM rag_documents), k AS (SELECT name, count(DISTINCT source) AS sources FROM c GROUP BY 1), a AS (SELECT unnest(['vision', 'hearing-aids', 'travel']) AS name) SELECT name, CAST(sources AS BIGINT) AS sources FROM k UNION ALL SELECT name, 0 FROM a WHERE name NOT IN (SELECT name FROM k)")
def _(spark, d):
    """Every category with its number of sources, and known names that no document has."""
    k = table(spark, d, "rag_documents").select(F.explode("categories").alias("name"), "source").groupBy("name").agg(F.count_distinct("source").alias("sources"))
    known = spark.createDataFrame([("vision",), ("hearing-aids",), ("travel",)], "name string")
    return k.unionByName(known.join(k, "name", "left_anti").select("name", F.lit(0).cast("bigint").alias("sources")))


@query("ret25_marked_tables", rf"WITH {_ROWS}, l AS (SELECT DISTINCT chunk_id FROM r WHERE regexp_matches(line, '\b80%')), v AS (SELECT DISTINCT chunk_id FROM r WHERE regexp_matches(lower(line), 'revision|last updated')) SELECT chunk_id FROM l WHERE chunk_id NOT IN (SELECT chunk_id FROM v)")
def _(spark, d):
    """Tables that aren't revision histories and hold a marked row."""
    r = _rows(spark, d).groupBy("chunk_id").agg(F.max(F.col("line").rlike(r"\b80%")).alias("marked"), F.max(F.lower("line").rlike("revision|last updated")).alias("history"))
    return r.where("marked AND NOT history").select("chunk_id")


@query("ret26_staged_search", r"""WITH a AS (SELECT document_id, page_number AS page, min(id) AS rank, 0 AS stage FROM rag_chunks WHERE regexp_matches(content, '\bD[0-9]{4}\b') GROUP BY 1, 2), b AS (SELECT document_id, page_number, min(id), 1 FROM rag_chunks WHERE contains(lower(content), 'sealant') GROUP BY 1, 2),
u AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY stage, rank) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY stage, rank, page) AS place FROM u WHERE k = 1)
SELECT document_id, page, CAST(place AS INTEGER) AS place FROM p WHERE place <= 4""")
def _(spark, d):
    """Pages with a code first, then pages with the word; a page counts once; four a document."""
    c = table(spark, d, "rag_chunks").select("id", "document_id", F.col("page_number").alias("page"), "content")
    pages = lambda cond: c.where(cond).groupBy("document_id", "page").agg(F.min("id").alias("rank"))
    out = L.staged([pages(F.col("content").rlike(r"\bD[0-9]{4}\b")), pages(F.lower("content").contains("sealant"))], ["document_id"], ["page"], "rank", 4)
    return out.select("document_id", "page", "place")


@query("scan4_gold_questions", "SELECT item_id FROM eval_items WHERE trim(coalesce(question, '')) <> '' AND trim(coalesce(passage, '')) <> ''")
def _(spark, d):
    good, _ = files.gold_questions(table(spark, d, "eval_items"), "question", F.array_compact(F.array(F.nullif(F.trim("passage"), F.lit("")))))
    return good.select("item_id")


@query("scan8_resolved_versions", "WITH r AS (SELECT document_id, max(document_version) AS v FROM chunk_records WHERE review_status = 'approved' GROUP BY 1), c AS (SELECT document_id, max(document_version) AS v FROM chunk_records GROUP BY 1) SELECT document_id, coalesce(r.v, c.v) AS version, CASE WHEN r.v IS NOT NULL THEN 'reviewed' WHEN c.v IS NOT NULL THEN 'candidate' END AS origin FROM c LEFT JOIN r USING (document_id)")
def _(spark, d):
    c = table(spark, d, "chunk_records").select("document_id", F.col("document_version").alias("v"), "review_status")
    return L.resolved(c.where("review_status = 'approved'"), c, "document_id", "v")


@query("scan14_page_tables", """SELECT id, 'Kept ' || coalesce(source, '') AS section, array_to_string(['Facts | name', 'Facts | value', 'column_3'], ';') AS headers, coalesce(primary_category, '') || ';' || coalesce(CAST(published AS VARCHAR), '') || ';x' AS cells FROM rag_documents""")
def _(spark, d):
    """Pages written from the table of documents, read again as tables with headings and headers of two rows."""
    p = "concat('<html><h2>Kept ', coalesce(source, ''), '</h2><table><tr><th colspan=\"2\">Facts</th><th></th></tr><tr><th>name</th><th>value</th><th></th></tr><tr><td>', coalesce(primary_category, ''), '</td><td>', coalesce(cast(published as string), ''), '</td><td>x</td></tr></table></html>')"
    pages = table(spark, d, "rag_documents").select("id", F.expr(p).alias("html"))
    return files.page_tables(pages, "id", "html").select("id", "section", F.array_join("headers", ";").alias("headers"), F.array_join("cells", ";").alias("cells"))


@query("scan21_manifest", "SELECT document, filename, CASE WHEN document LIKE 'dental-%' THEN 'dental/' || filename ELSE filename END AS path, CASE WHEN title IS NULL THEN 'no title' WHEN count(*) OVER (PARTITION BY filename) > 1 THEN 'path twice' END AS problem FROM demo_documents")
def _(spark, d):
    m = table(spark, d, "demo_documents").select("document", "filename", "title")
    return files.manifest(m, "document", "filename", ["title"], F.when(F.col("document").startswith("dental-"), F.concat(F.lit("dental/"), "filename"))).select("document", "filename", "path", "problem")


@query("scan22_feed_entries", "SELECT id, title, array_to_string(authors, ';') AS authors, CAST(published AS DATE) AS published FROM rag_documents WHERE len(authors) > 1 AND published IS NOT NULL AND title IS NOT NULL AND NOT regexp_matches(title, '[<>&]')")
def _(spark, d):
    """Feed entries in XML, written from the table of documents and read again."""
    r = table(spark, d, "rag_documents").where("size(authors) > 1 AND published IS NOT NULL AND title IS NOT NULL AND NOT title RLIKE '[<>&]'")
    names = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), a, F.lit("</name></author>"))), "")
    xml = F.concat(F.lit("<entry><id>"), "id", F.lit("</id><title>"), "title", F.lit("</title>"), names, F.lit("<published>"), F.col("published").cast("string"), F.lit("T00:00:00Z</published></entry>"))
    e = files.feed_entries(r.select(xml.alias("entry")), "entry")
    return e.select("id", "title", F.array_join("authors", ";").alias("authors"), "published")


@query("scan26_latest_per_place", "SELECT document_id, page_number, arg_max(id, (ingested_at, id)) AS id FROM rag_chunks WHERE content_type = 'figure' AND ingested_at IS NOT NULL GROUP BY ALL")
def _(spark, d):
    c = table(spark, d, "rag_chunks").where("content_type = 'figure' AND ingested_at IS NOT NULL")
    return c.groupBy("document_id", "page_number").agg(F.max_by("id", F.struct("ingested_at", "id")).alias("id"))


@query("sink8_parents", "SELECT CAST('0x' || substring(md5(coalesce(document_id, '') || chr(1) || coalesce(CAST(page_number AS VARCHAR), '')), 1, 15) AS BIGINT) AS parent, document_id, page_number, CAST(count(*) AS BIGINT) AS children FROM rag_chunks GROUP BY ALL")
def _(spark, d):
    p = table(spark, d, "rag_chunks").groupBy("document_id", "page_number").agg(F.count("*").alias("children"))
    return L.with_surrogate_key(p, "parent", "document_id", "page_number").select("parent", "document_id", "page_number", "children")


@query("sink10_mirror_actions", "WITH a AS (SELECT id, md5(coalesce(title, '')) AS h FROM rag_documents WHERE source <> 'upload'), b AS (SELECT id, md5(coalesce(primary_category, coalesce(title, ''))) AS h FROM rag_documents WHERE published IS NOT NULL) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'insert' WHEN a.id IS NULL THEN 'delete' ELSE 'update' END AS action FROM a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.h <> b.h")
def _(spark, d):
    r = table(spark, d, "rag_documents")
    a, b = r.where("source <> 'upload'").select("id", F.coalesce("title", F.lit("")).alias("t")), r.where("published IS NOT NULL").select("id", F.coalesce("primary_category", "title", F.lit("")).alias("t"))
    return L.mirrored(a, b, "id", F.md5("t"))


@query("sink18_not_cached", "SELECT DISTINCT chunk_id FROM chunk_records WHERE source_sha256 NOT IN (SELECT source_sha256 FROM chunk_records WHERE review_status = 'approved')")
def _(spark, d):
    c = table(spark, d, "chunk_records")
    return L.not_cached(c, c.where("review_status = 'approved'"), "source_sha256").select("chunk_id").distinct()


@query("win7_header_runs", """WITH t AS (SELECT o_custkey AS k, CAST(o_orderkey // 8 AS INTEGER) AS page, min(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY 1, 2), h AS (SELECT k, page, CASE WHEN s = 'F' THEN ['column_1', 'column_2'] ELSE [s, 'n' || n] END AS headers FROM t),
f AS (SELECT *, coalesce(headers[1] LIKE 'column%' AND page = lag(page) OVER w + 1, false) AS f FROM h WINDOW w AS (PARTITION BY k ORDER BY page)), r AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY page) AS run FROM f)
SELECT k, page, array_to_string(first_value(headers) OVER (PARTITION BY k, run ORDER BY page), ';') AS shown FROM r""")
def _(spark, d):
    t = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.expr("CAST(o_orderkey DIV 8 AS INT)").alias("page")).agg(F.min("o_orderstatus").alias("s"), N())
    h = t.select("k", "page", F.when(F.col("s") == "F", F.array(F.lit("column_1"), F.lit("column_2"))).otherwise(F.array("s", F.concat(F.lit("n"), "n"))).alias("headers"))
    return L.header_runs(h, "k", "page", "headers").select("k", "page", F.array_join("shown", ";").alias("shown"))


@query("cls5_section_classes", "WITH l AS (SELECT id, document_id, chunk_index, CASE WHEN regexp_matches(lower(content), '^.{0,80}(appeal|grievance)') THEN 'appeals' WHEN regexp_matches(lower(content), '^.{0,80}(fee|cost|price)') THEN 'costs' WHEN regexp_matches(lower(content), '^.{0,80}(contents|overview)') THEN 'overview' END AS own FROM rag_chunks) SELECT id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'general') AS class FROM l")
def _(spark, d):
    """A chunk that opens a section takes its class, the others that of the section they are in."""
    t = F.lower("content")
    own = F.when(t.rlike("^.{0,80}(appeal|grievance)"), "appeals").when(t.rlike("^.{0,80}(fee|cost|price)"), "costs").when(t.rlike("^.{0,80}(contents|overview)"), "overview")
    c = table(spark, d, "rag_chunks").select("id", "document_id", "chunk_index", own.alias("own"))
    return ranges.running_last(c, "document_id", "chunk_index", "id", F.col("own"), "class").select("id", F.coalesce("class", F.lit("general")).alias("class"))


@query("chk16_split_rows", r"WITH t AS (SELECT DISTINCT chunk_id, replace(text, chr(10), ' ') AS t FROM chunk_records WHERE content_type = 'table_row'), x AS (SELECT chunk_id, regexp_extract_all(t, '\b[A-Z][0-9]{4}\b') AS n, regexp_extract_all(t, '\$[0-9][0-9,]*(?:\.[0-9]+)?') AS a FROM t) SELECT chunk_id, CAST(i AS INTEGER) AS place, n[i + 1] AS name, a[i + 1] AS amount FROM (SELECT chunk_id, n, a, unnest(range(len(n))) AS i FROM x WHERE len(n) > 1 AND len(n) = len(a))")
def _(spark, d):
    t = table(spark, d, "chunk_records").where("content_type = 'table_row'").select("chunk_id", F.replace(F.col("text"), F.lit("\n"), F.lit(" ")).alias("t")).distinct()
    return L.split_merged(t, "chunk_id", "t", r"\b[A-Z][0-9]{4}\b", r"\$[0-9][0-9,]*(?:\.[0-9]+)?")


@query("chk18_page_cuts", """WITH i AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y, value / 100 AS ink FROM events), k AS (SELECT *, CASE WHEN ink >= 0.9 THEN 'rule' WHEN ink <= 0.3 THEN 'gap' END AS kind FROM i),
r AS (SELECT *, sum(CASE WHEN kind IS NOT DISTINCT FROM p AND n THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY page ORDER BY y) AS p, row_number() OVER (PARTITION BY page ORDER BY y) > 1 AS n FROM k))
SELECT page, (min(y) + max(y)) // 2 AS cut, any_value(kind) AS kind FROM r WHERE kind IS NOT NULL GROUP BY page, run HAVING any_value(kind) = 'rule' OR count(*) >= 2""")
def _(spark, d):
    """Rows of a page and their ink, for which events stand in."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ink = table(spark, d, "events").select(F.col("user_id").alias("page"), F.row_number().over(w).cast("bigint").alias("y"), (F.col("value") / 100).alias("ink"))
    return L.page_cuts(ink, "page", "y", "ink", 0.3, 2, 0.9)


@query("udf5_6_learned_tool", "SELECT l_suppkey AS provider, round(max(l_extendedprice / l_quantity), 6) AS score FROM lineitem GROUP BY 1")
def _(spark, d):
    """A tool given as text: checked first, then run on each group in a worker."""
    code = 'def dearest(rows: list) -> float:\n    """The greatest price of a unit."""\n    return max(r["paid"] / r["units"] for r in rows)\n'
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("provider"), F.col("l_extendedprice").cast("double").alias("paid"), F.col("l_quantity").cast("double").alias("units"))
    return learned.applied(rows, "provider", code).select("provider", F.round("score", 6).alias("score"))


@query("udf9_classifier", "SELECT event_id, CASE WHEN value >= 90 THEN 0.9 WHEN value >= 50 THEN 0.5 ELSE 0.1 END AS p FROM events")
def _(spark, d):
    return learned.asked(table(spark, d, "events"), "event_id", learned.Rules([(F.col("value") >= 90, 0.9), (F.col("value") >= 50, 0.5)], 0.1)).select("event_id", F.col("probability").alias("p"))


@query("udf10_embedder")
def _(spark, d):
    """Vectors by an embedder handed in: here one of hashed words, the same on every run."""
    return learned.embedded(table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", "content"), "content", learned.HashEmbedder(32)).select("id", "vector")


@query("scal23_nested_redaction", "SELECT id, '[REDACTED]' AS name, 'call [PHONE]' AS note FROM rag_documents")
def _(spark, d):
    r = table(spark, d, "rag_documents").select("id", F.create_map(F.lit("Name"), F.coalesce("title", F.lit("x")), F.lit("note"), F.lit("call 212-555-0142")).alias("m"))
    m = guards.redacted_map("m")
    return r.select("id", m["Name"].alias("name"), m["note"].alias("note"))
