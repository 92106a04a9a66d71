"""Queries of predicates on chunks, noise statistics and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import predicates as P
from codexa.operators import quality as Q
from codexa.operators.graph import connected_components, ensure_checkpoint_dir
from codexa.operators.ranges import numbered
from codexa.operators import guards as G
from codexa.plans.policy import _BLOCKED
from codexa.plans.registry import query
from codexa.sources.tables import few, spread, table


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Each delivered chunk once."""
    return table(spark, d, "chunk_records").groupBy("chunk_id").agg(*[F.max(c).alias(c) for c in ("document_id", "text", "section", "content_type", "plan_year")])


_C = "c AS (SELECT chunk_id, max(document_id) AS document_id, max(text) AS text, max(section) AS section, max(content_type) AS content_type, max(plan_year) AS plan_year FROM chunk_records GROUP BY 1)"
_F = "f AS (SELECT document_id, arg_max(family, (created_at, run_id)) AS family FROM document_stats GROUP BY 1)"


def families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_stats").groupBy("document_id").agg(F.max_by("family", F.struct("created_at", "run_id")).alias("family"))


def _flag(name: str, fn, sql: str) -> None:
    @query(name, f"WITH {_C} SELECT chunk_id, {sql} AS flag FROM c")
    def run(spark, d):
        return chunks(spark, d).select("chunk_id", fn("text").alias("flag"))


_TOC = r"len(regexp_extract_all(text, '(?m)\.{5,}\s*[0-9]+|\s{2,}[0-9]+\s*$')) >= 3"
_FORM = r"len(regexp_extract_all(text, '(?im)_{4,}|☐|□|\[\s\]|(?:signature|date of birth|member id|ssn)\s*:?\s*$')) >= 2"
_TINY = r"len(regexp_extract_all(text, '[\pL\pN_]+')) < 25"
_flag("proj14_toc_chunks", P.is_toc, _TOC)
_flag("proj15_form_chunks", P.is_form, _FORM)
_flag("proj16_tiny_chunks", P.is_tiny, _TINY)


@query("proj5_whole_word", r"SELECT id, regexp_matches(content, '(?i)\bcrown\b') AS flag FROM rag_chunks WHERE content IS NOT NULL")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.col("content").rlike(r"(?i)\bcrown\b").alias("flag"))


@query("proj6_nonempty_arrays", "SELECT id, coalesce(len(authors), 0) > 0 AS has_authors FROM rag_documents")
def _(spark, d):
    return table(spark, d, "rag_documents").select("id", (F.coalesce(F.size("authors"), F.lit(0)) > 0).alias("has_authors"))


@query("proj7_in_types", "SELECT id FROM rag_chunks WHERE content_type IN ('table', 'figure')")
def _(spark, d):
    return table(spark, d, "rag_chunks").where(F.col("content_type").isin("table", "figure")).select("id")


@query("proj8_phrase_containment", "SELECT id FROM rag_chunks WHERE contains(' ' || trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) || ' ', ' fluoride varnish ')")
def _(spark, d):
    return table(spark, d, "rag_chunks").where(P.contains_words("content", F.lit("Fluoride  varnish"))).select("id")


@query("proj9_condition_mention", r"SELECT item_id, regexp_matches(lower(question), 'sealant|crown|implant') OR regexp_matches(question, '\((HMO|PPO)\)') AS mentioned FROM eval_items")
def _(spark, d):
    q = F.col("question")
    words = F.arrays_overlap(X.found(q, r"\(([A-Z]{2,})\)", 1), F.array(F.lit("HMO"), F.lit("PPO")))
    said = F.lower(q).rlike("sealant|crown|implant")
    return table(spark, d, "eval_items").select("item_id", (said | words).alias("mentioned"))


@query("proj10_source_mention", "SELECT id, len(split_part(id, '-', 1)) >= 4 AND contains(lower(coalesce(title, '')), split_part(id, '-', 1)) AS mentioned FROM rag_documents")
def _(spark, d):
    stem = F.split("id", "-")[0]
    return table(spark, d, "rag_documents").select("id", ((F.length(stem) >= 4) & F.lower(F.coalesce("title", F.lit(""))).contains(stem)).alias("mentioned"))


@query("proj11_query_intent", "SELECT item_id, len(list_intersect(regexp_extract_all(lower(question), '[a-z0-9]+'), ['how', 'many', 'which'])) > 0 AS inventory FROM eval_items")
def _(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.arrays_overlap(X.tokens_alnum("question"), F.array(*map(F.lit, ("how", "many", "which")))).alias("inventory"))


@query("proj12_table_rows", rf"WITH {_C}, l AS (SELECT chunk_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM c WHERE content_type = 'table_row') SELECT chunk_id, round(len(list_filter(lines, lambda x: regexp_matches(x, '20[0-9][0-9]'))) / len(lines), 6) AS dated FROM l WHERE len(lines) > 0")
def _(spark, d):
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    t = chunks(spark, d).where("content_type = 'table_row'").select("chunk_id", lines.alias("lines")).where(F.size("lines") > 0)
    return t.select("chunk_id", F.round(F.size(F.filter("lines", lambda x: x.rlike("20[0-9][0-9]"))) / F.size("lines"), 6).alias("dated"))


@query("proj13_without_sections", f"WITH {_C} SELECT chunk_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^.{{0,4}}(last updated|reviewed for|printed copies)')), chr(10)) AS text FROM c")
def _(spark, d):
    keep = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike("(?i)^.{0,4}(last updated|reviewed for|printed copies)"))
    return chunks(spark, d).select("chunk_id", F.array_join(keep, "\n").alias("text"))


@query("proj18_toc_reasons", rf"""WITH {_C}, l AS (SELECT chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM c), n AS (SELECT chunk_id, lines, len(lines) AS k, len(list_filter(lines, lambda x: regexp_matches(x, '\.{{3,}}|(?:\. ){{3,}}'))) AS leaders, len(list_filter(lines, lambda x: regexp_matches(x, '[0-9]+\s*\|?$'))) AS entries FROM l)
SELECT chunk_id, CASE WHEN regexp_matches(lower(lines[1]), '^(?:table of )?contents$') THEN 'toc_heading' WHEN k >= 4 AND (leaders >= 2 OR entries >= 0.6 * k) THEN 'toc_layout' END AS reason FROM n""")
def _(spark, d):
    return chunks(spark, d).select("chunk_id", P.toc_reason("text").alias("reason"))


_flag("proj19_references", P.looks_like_references, " OR ".join(f"len(regexp_extract_all(text, '{p}')) > {n}" for p, n in P.REFERENCES))


@query("proj20_kept_figures", "SELECT id FROM rag_chunks WHERE content_type = 'figure' AND (image IS NOT NULL OR length(content) >= 150)")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content_type = 'figure' AND (image IS NOT NULL OR length(content) >= 150)").select("id")


@query("proj21_similar_questions", """WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS p FROM eval_items) SELECT item_id, len(list_intersect(q, p)) / greatest(len(list_distinct(q || p)), 1) >= 0.1 AS similar FROM w""")
def _(spark, d):
    return table(spark, d, "eval_items").select("item_id", P.too_similar("question", "passage", 0.1, None).alias("similar"))


@query("proj22_guard_reasons", f"SELECT doc_id, {_BLOCKED} AS reason FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", G.guard_reason("text").alias("reason"))


@query("proj23_chunk_problems", r"""WITH x AS (SELECT *, count(*) OVER (PARTITION BY chunk_id) AS n FROM chunk_records) SELECT chunk_id, level, problem FROM (SELECT chunk_id, 'error' AS level, 'duplicate_id' AS problem FROM x WHERE n > 1 UNION ALL SELECT chunk_id, 'error', 'empty_text' FROM x WHERE text IS NULL OR trim(text) = ''
UNION ALL SELECT chunk_id, 'error', 'missing_page_provenance' FROM x WHERE pages IS NULL OR len(pages) = 0 UNION ALL SELECT chunk_id, 'warning', 'unsectioned' FROM x WHERE section IS NULL UNION ALL SELECT chunk_id, 'warning', 'context_too_short' FROM x WHERE len(regexp_extract_all(text, '[\pL\pN_]+')) < 8)""")
def _(spark, d):
    return P.chunk_problems(table(spark, d, "chunk_records"))


@query("proj24_contiguous_pages", "WITH p AS (SELECT DISTINCT document_id, unnest(pages) AS page FROM chunk_records) SELECT document_id, min(page) = 1 AND max(page) = count(*) AS contiguous FROM p GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "chunk_records").select("document_id", F.explode("pages").alias("page")).distinct()
    return p.groupBy("document_id").agg(((F.min("page") == 1) & (F.max("page") == F.count("*"))).alias("contiguous"))


@query("proj26_row_search_text", rf"""WITH {_C}, r AS (SELECT chunk_id, document_id, section, row - 1 AS row, string_split_regex(lines[row], '[;\t|]') AS cells FROM (SELECT chunk_id, document_id, section, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS row FROM c WHERE content_type = 'table_row')),
x AS (SELECT *, list_filter([CASE WHEN trim(coalesce(cells[1], '')) <> '' THEN 'service: ' || trim(cells[1]) END, CASE WHEN trim(coalesce(cells[2], '')) <> '' THEN 'code: ' || trim(cells[2]) END, CASE WHEN trim(coalesce(cells[3], '')) <> '' THEN 'fee: ' || trim(cells[3]) END, CASE WHEN trim(coalesce(cells[4], '')) <> '' THEN 'year: ' || trim(cells[4]) END], lambda v: v IS NOT NULL) AS shown FROM r)
SELECT chunk_id, CAST(row AS INTEGER) AS row, concat_ws('. ', document_id, section, coalesce(array_to_string(shown, '; '), '')) AS search_text FROM x""")
def _(spark, d):
    rows = chunks(spark, d).where("content_type = 'table_row'").select("chunk_id", "document_id", "section", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    cell = lambda h, i: F.struct(F.lit(h).alias("header"), F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias("value"))
    cells = F.array(*[cell(h, i) for i, h in enumerate(("service", "code", "fee", "year"))])
    return rows.withColumn("cells", F.split("line", "[;\t|]")).select("chunk_id", "row", P.search_text("document_id", "section", cells).alias("search_text"))


@query("proj27_context_text", f"WITH {_C} SELECT chunk_id, concat_ws(' | ', document_id, section) || chr(10) || text AS context FROM c")
def _(spark, d):
    return chunks(spark, d).select("chunk_id", F.concat(F.concat_ws(" | ", "document_id", "section"), F.lit("\n"), F.col("text")).alias("context"))


@query("proj28_evidence_context", "SELECT document_id, string_agg('[' || CAST(r AS VARCHAR) || '] p. ' || coalesce(CAST(page_number AS VARCHAR), '?') || ' ' || substring(content, 1, 300), chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS r FROM rag_chunks WHERE content IS NOT NULL) WHERE r <= 5 GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("document_id").orderBy("chunk_index", "id")
    r = table(spark, d, "rag_chunks").where("content IS NOT NULL").withColumn("r", F.row_number().over(w)).where("r <= 5")
    line = F.concat(F.lit("["), F.col("r"), F.lit("] p. "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(" "), F.substring("content", 1, 300))
    g = r.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("r", line.alias("line")))).alias("x"))
    return g.select("document_id", F.array_join(F.transform("x", lambda s: s.line), "\n").alias("context"))


@query("proj33_library_answer", "SELECT coalesce(primary_category, 'none') AS category, CASE WHEN count(*) > 3 THEN CAST(count(*) AS VARCHAR) || ' documents' ELSE string_agg(id, ', ' ORDER BY id) END AS answer FROM rag_documents GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "rag_documents").groupBy(F.coalesce("primary_category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"), F.array_sort(F.slice(F.array_sort(F.collect_list("id")), 1, 4)).alias("ids"))
    return g.select("category", F.when(F.col("n") > 3, F.concat(F.col("n"), F.lit(" documents"))).otherwise(F.array_join("ids", ", ")).alias("answer"))


@query("proj34_string_maps", "SELECT id, coalesce(trim(title), '') AS title, coalesce(trim(source), '') AS source, coalesce(trim(primary_category), '') AS category FROM rag_documents")
def _(spark, d):
    m = F.transform_values(F.create_map(*[x for c in ("title", "source", "primary_category") for x in (F.lit(c), F.col(c))]), lambda k, v: F.coalesce(F.trim(v), F.lit("")))
    return table(spark, d, "rag_documents").select("id", m.alias("m")).select("id", F.col("m.title").alias("title"), F.col("m.source").alias("source"), F.col("m.primary_category").alias("category"))


_LINES = f"""{_C}, {_F}, x AS (SELECT c.chunk_id, c.document_id, family, trim(l) AS l FROM (SELECT chunk_id, document_id, unnest(string_split(text, chr(10))) AS l FROM c) c JOIN f USING (document_id)),
m AS (SELECT chunk_id, document_id, family, l, regexp_replace(lower(trim(l)), '[0-9]+', '#', 'g') AS line FROM x), nd AS (SELECT family, count(DISTINCT c.document_id) AS k FROM c JOIN f USING (document_id) GROUP BY 1),
bl AS (SELECT family, line, count(DISTINCT document_id) AS docs FROM m WHERE length(l) BETWEEN 8 AND 120 GROUP BY ALL), b AS (SELECT bl.family, line, docs FROM bl JOIN nd USING (family) WHERE docs >= greatest(5, 0.1 * k))"""


def _with_family(spark, d):
    return chunks(spark, d).join(families(spark, d), "document_id")


@query("agg7_line_frequency", f"WITH {_LINES} SELECT family, line, CAST(docs AS BIGINT) AS docs FROM b")
def _(spark, d):
    return Q.boilerplate_lines(_with_family(spark, d), "family", "document_id")


@query("proj17_boilerplate_share", f"WITH {_LINES} SELECT chunk_id, round(avg(CAST(b.line IS NOT NULL AS INTEGER)), 6) AS share, avg(CAST(b.line IS NOT NULL AS INTEGER)) >= 0.5 AS flagged FROM m LEFT JOIN b ON b.family = m.family AND b.line = m.line WHERE m.l <> '' GROUP BY 1")
def _(spark, d):
    c = _with_family(spark, d)
    s = Q.boilerplate_share(c, Q.boilerplate_lines(c, "family", "document_id"), "chunk_id", "family")
    return s.select("chunk_id", F.round("share", 6).alias("share"), (F.col("share") >= 0.5).alias("flagged"))


_DS = f"""{_C}, {_F}, w AS (SELECT chunk_id, document_id, family, len(regexp_extract_all(text, '[\\pL\\pN_]+')) AS words, {_TOC} AS toc, {_FORM} AS form, {_TINY} AS tiny, content_type = 'table_row' AS tab FROM c JOIN f USING (document_id)),
ds AS (SELECT document_id, any_value(family) AS family, count(*) AS chunks, median(words) AS median_words, list_sort(list(words))[CAST(floor(0.9 * (count(*) - 1)) AS INTEGER) + 1] AS p90_words, count(*) FILTER (toc) AS toc, count(*) FILTER (form) AS form, count(*) FILTER (tiny) AS tiny, count(*) FILTER (tab) AS table_chunks FROM w GROUP BY 1)"""


def _doc_stats(spark, d):
    w = _with_family(spark, d).select("document_id", "family", F.regexp_count("text", F.lit(r"(?U)\w+")).alias("words"), P.is_toc("text").alias("toc"), P.is_form("text").alias("form"), P.is_tiny("text").alias("tiny"), (F.col("content_type") == "table_row").alias("tab"))
    p90 = Q.counted_percentile(w, ["document_id"], "words", 0.9)
    g = w.groupBy("document_id").agg(F.max("family").alias("family"), F.count("*").alias("chunks"), F.median("words").alias("median_words"), *[F.count_if(c).alias(n) for c, n in (("toc", "toc"), ("form", "form"), ("tiny", "tiny"), ("tab", "table_chunks"))])
    return g.join(p90, "document_id").withColumnRenamed("value", "p90_words")


@query("agg2_median_p90", f"WITH {_DS} SELECT document_id, median_words, CAST(p90_words AS BIGINT) AS p90_words FROM ds")
def _(spark, d):
    return _doc_stats(spark, d).select("document_id", "median_words", F.col("p90_words").cast("bigint").alias("p90_words"))


@query("agg5_corpus_summary", f"WITH {_DS} SELECT family, CAST(count(*) AS BIGINT) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, round(median(median_words), 4) AS median_words, round(100.0 * sum(tiny) / sum(chunks), 4) AS tiny_pct, CAST(count(*) FILTER (toc > 0) AS BIGINT) AS with_toc FROM ds GROUP BY 1")
def _(spark, d):
    return _doc_stats(spark, d).groupBy("family").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.round(F.median("median_words"), 4).alias("median_words"), F.round(100.0 * F.sum("tiny") / F.sum("chunks"), 4).alias("tiny_pct"), F.count_if(F.col("toc") > 0).alias("with_toc"))


@query("agg6_grouping_levels", f"WITH {_DS}, b AS (SELECT *, CASE WHEN chunks <= 2 THEN '1-2' WHEN chunks <= 5 THEN '3-5' WHEN chunks <= 15 THEN '6-15' ELSE '16-' END AS bucket FROM ds) SELECT coalesce(family, '*') AS family, coalesce(bucket, '*') AS bucket, CAST(count(*) AS BIGINT) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks FROM b GROUP BY GROUPING SETS ((), (family), (bucket))")
def _(spark, d):
    b = _doc_stats(spark, d).withColumn("bucket", F.when(F.col("chunks") <= 2, "1-2").when(F.col("chunks") <= 5, "3-5").when(F.col("chunks") <= 15, "6-15").otherwise("16-"))
    g = b.groupingSets([[], ["family"], ["bucket"]], "family", "bucket").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"))
    return g.select(F.coalesce("family", F.lit("*")).alias("family"), F.coalesce("bucket", F.lit("*")).alias("bucket"), "documents", "chunks")


@query("agg8_concentration", "WITH n AS (SELECT document_id, count(*) AS n FROM rag_chunks GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r FROM n) SELECT k, round(sum(n) / (SELECT sum(n) FROM n), 6) AS share FROM r, (SELECT unnest([1, 3, 5, 10]) AS k) WHERE r <= k GROUP BY k")
def _(spark, d):
    return Q.concentration(table(spark, d, "rag_chunks").groupBy("document_id").agg(F.count("*").alias("n")), [1, 3, 5, 10])


@query("agg9_log_slope", "WITH n AS (SELECT document_id, count(*) AS chunks, count(DISTINCT page_number) AS pages FROM rag_chunks GROUP BY 1) SELECT round(regr_slope(ln(chunks), ln(pages)), 6) AS slope, CAST(count(*) AS BIGINT) AS n FROM n WHERE pages > 0")
def _(spark, d):
    n = table(spark, d, "rag_chunks").groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_distinct("page_number").alias("pages")).where("pages > 0")
    return n.agg(F.round(F.regr_slope(F.log("chunks"), F.log("pages")), 6).alias("slope"), F.count("*").alias("n"))


def _pct(name: str, of: str, q: float, at: str) -> None:
    @query(name, f"SELECT event_type, list_sort(list(value))[CAST({at} AS INTEGER) + 1] AS value FROM events GROUP BY 1")
    def run(spark, d):
        return Q.counted_percentile(table(spark, d, "events"), ["event_type"], "value", q, of)


_pct("agg10_percentile_floor", "n", 0.9, "least(floor(0.9 * count(*)), count(*) - 1)")
_pct("agg12_percentile_ceil", "ceil", 0.95, "ceil(0.95 * count(*)) - 1")


@query("agg11_percentile_linear", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS value FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.9)), 6).alias("value"))


@query("agg13_size_profile", "WITH t AS (SELECT document_id, ceil(length(content) / 4.0) AS tokens FROM rag_chunks WHERE content IS NOT NULL) SELECT CAST(min(tokens) AS BIGINT) AS least, round(avg(tokens), 6) AS mean, round(quantile_cont(tokens, 0.5), 4) AS p50, round(quantile_cont(tokens, 0.95), 4) AS p95, CAST(max(tokens) AS BIGINT) AS most, CAST(count(*) FILTER (tokens > 350) AS BIGINT) AS over_budget, CAST(count(*) FILTER (tokens < 87.5) AS BIGINT) AS under_quarter FROM t")
def _(spark, d):
    t = table(spark, d, "rag_chunks").where("content IS NOT NULL").select(X.token_estimate("content").alias("tokens"))
    c = F.col("tokens")
    return t.agg(F.min(c).alias("least"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(c, F.lit(0.95)), 4).alias("p95"), F.max(c).alias("most"), F.count_if(c > 350).alias("over_budget"), F.count_if(c < 87.5).alias("under_quarter"))


_N = "n AS (SELECT id, trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) AS norm FROM rag_chunks WHERE content IS NOT NULL)"


@query("ded1_exact_groups", f"WITH {_N}, g AS (SELECT norm, min(id) AS representative, count(*) AS copies FROM n WHERE norm <> '' GROUP BY 1 HAVING count(*) > 1) SELECT id, representative, CAST(copies AS BIGINT) AS copies FROM n JOIN g USING (norm)")
def _(spark, d):
    return Q.exact_groups(table(spark, d, "rag_chunks"), "id", "content")


@query("ded2_shingles", """WITH t AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS t FROM rag_chunks WHERE content IS NOT NULL) SELECT id, CAST(CASE WHEN len(t) = 0 THEN 0 WHEN len(t) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) END AS BIGINT) AS shingles FROM t""")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.size(X.let(X.tokens_alnum("content"), lambda t: Q.shingles(t, 3))).cast("bigint").alias("shingles"))


def _docs(spark, d):
    """Documents whose words are the same once."""
    t = spread(table(spark, d, "documents").select("doc_id", "text").where("doc_id IS NOT NULL"))
    ensure_checkpoint_dir(t)
    held = t.select("doc_id", F.unhex(F.sha1(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")))).alias("h")).checkpoint()
    several = few(held.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").checkpoint())
    again = few(held.alias("x").join(several.alias("y"), F.expr("x.h <=> y.h")).where("doc_id <> least").select("doc_id").checkpoint())
    return t.join(again, "doc_id", "left_anti")  # texts stay where they are, unless copies are very many


_PAIRS = """dd AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')))),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM dd), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' ')) END) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (sh) WHERE x.doc_id < y.doc_id GROUP BY ALL),
pr AS (SELECT a, b, k / (na.n + nb.n - k) AS jaccard, k / least(na.n, nb.n) AS containment FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE k / (na.n + nb.n - k) >= 0.8 OR k / least(na.n, nb.n) >= 0.95)"""


@query("ded5_6_similar_pairs", f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment, CASE WHEN jaccard >= 0.8 THEN 'near' ELSE 'contained' END AS kind FROM pr")
def _(spark, d):
    return Q.similar_pairs(_docs(spark, d), "doc_id", "text")


@query("ded3_4_minhash_bands")
def _(spark, d):
    """Candidate pairs by 64 bands of two of 128 minima; hot bands are left to the exact operator."""
    return Q.candidate_pairs(_docs(spark, d), "doc_id", "text")


_NUM = r"list_distinct(list_transform(regexp_extract_all(lower(text), '\$[0-9][0-9,]*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?%|\b[0-9]+[a-z]\b'), lambda x: replace(x, ',', '')))"


@query("ded7_numbers_differ", f"""WITH {_PAIRS}, nu AS (SELECT doc_id, {_NUM} AS u, length(text) AS l FROM dd), j AS (SELECT a, b, jaccard, x.u AS ua, y.u AS ub, x.l AS la, y.l AS lb FROM pr JOIN nu x ON x.doc_id = a JOIN nu y ON y.doc_id = b),
o AS (SELECT *, len(list_filter(ua, lambda v: NOT list_contains(ub, v))) > 0 AS oa, len(list_filter(ub, lambda v: NOT list_contains(ua, v))) > 0 AS ob FROM j) SELECT a, b, CASE WHEN jaccard >= 0.8 THEN oa OR ob WHEN la <= lb THEN oa ELSE ob END AS differs FROM o""")
def _(spark, d):
    docs = _docs(spark, d)
    return Q.numbers_differ(Q.similar_pairs(docs, "doc_id", "text"), docs, "doc_id", "text").select("a", "b", "differs")


_COMP = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS u, b AS v FROM pr UNION SELECT b, a FROM pr), r AS (SELECT DISTINCT u AS node, u AS reach FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reach), cp AS (SELECT node, min(reach) AS component FROM r GROUP BY 1)"""


@query("ded8_components", f"{_COMP} SELECT node, component FROM cp")
def _(spark, d):
    return connected_components(Q.similar_pairs(_docs(spark, d), "doc_id", "text"))


_CL = f"""{_COMP}, k AS (SELECT node AS doc_id, component AS cluster, count(*) OVER (PARTITION BY component) AS size, row_number() OVER (PARTITION BY component ORDER BY length(text) DESC, node) = 1 AS canonical, length(text) AS len, source FROM cp JOIN (SELECT doc_id, text, source FROM documents) d ON d.doc_id = cp.node)"""


def _clusters(spark, d):
    docs = _docs(spark, d)
    return Q.clusters(Q.similar_pairs(docs, "doc_id", "text"), docs, "doc_id", "text")


@query("ded9_canonical", f"{_CL} SELECT doc_id, cluster, CAST(size AS BIGINT) AS size, canonical FROM k")
def _(spark, d):
    return _clusters(spark, d)


@query("sort8_longest_first", f"{_CL} SELECT cluster, doc_id FROM k WHERE canonical")
def _(spark, d):
    return _clusters(spark, d).where("canonical").select("cluster", "doc_id")


@query("ded10_cluster_rollup", f"{_CL} SELECT cluster, CAST(count(*) AS BIGINT) AS size, CAST(count(DISTINCT source) AS BIGINT) AS sources, CASE WHEN count(DISTINCT source) > 1 THEN 'cross' ELSE 'within' END AS scope, CAST(sum(CASE WHEN canonical THEN 0 ELSE len END) AS BIGINT) AS redundant_chars FROM k GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("len"))
    g = _clusters(spark, d).join(docs, "doc_id").groupBy("cluster")
    return g.agg(F.count("*").alias("size"), F.count_distinct("source").alias("sources"), F.when(F.count_distinct("source") > 1, "cross").otherwise("within").alias("scope"), F.sum(F.when(F.col("canonical"), 0).otherwise(F.col("len")).cast("bigint")).alias("redundant_chars"))


@query("agg22_pair_summary", f"WITH {_PAIRS}, k AS (SELECT a, b, CASE WHEN jaccard >= 0.8 THEN 'near' ELSE 'contained' END AS kind FROM pr) SELECT kind, CAST(count(*) AS BIGINT) AS pairs, CAST((SELECT count(DISTINCT x) FROM (SELECT a AS x FROM k k2 WHERE k2.kind = k.kind UNION SELECT b FROM k k3 WHERE k3.kind = k.kind)) AS BIGINT) AS documents FROM k GROUP BY kind")
def _(spark, d):
    p = Q.similar_pairs(_docs(spark, d), "doc_id", "text")
    n = p.select("kind", F.explode(F.array("a", "b")).alias("x")).groupBy("kind").agg(F.count_distinct("x").alias("documents"))
    return p.groupBy("kind").agg(F.count("*").alias("pairs")).join(n, "kind")


@query("agg23_redundancy_rollup", f"{_CL} SELECT source, CAST(count(*) AS BIGINT) AS involved, CAST(count(*) FILTER (NOT canonical) AS BIGINT) AS redundant, CAST(sum(len) AS BIGINT) AS chars FROM k GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("len"))
    return _clusters(spark, d).join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("involved"), F.count_if(~F.col("canonical")).alias("redundant"), F.sum("len").alias("chars"))


@query("sort10_cluster_ids", f"{_CL}, g AS (SELECT cluster, count(*) AS size, sum(CASE WHEN canonical THEN 0 ELSE len END) AS red FROM k GROUP BY 1) SELECT 'c' || lpad(CAST(row_number() OVER (ORDER BY size DESC, red DESC, cluster) AS VARCHAR), 4, '0') AS name, cluster FROM g")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").alias("len"))
    g = _clusters(spark, d).join(docs, "doc_id").groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.when(F.col("canonical"), 0).otherwise(F.col("len"))).alias("red"))
    g = numbered(g, [F.desc("size"), F.desc("red"), F.col("cluster")], "place")
    return g.select(F.concat(F.lit("c"), F.lpad(F.col("place").cast("string"), 4, "0")).alias("name"), "cluster")


@query("ded11_pages_without_chunks", "WITH s AS (SELECT document_id, list_distinct(flatten(list(pages))) AS seen FROM chunk_records WHERE pages IS NOT NULL GROUP BY 1), p AS (SELECT document, unnest(range(1, page_count + 1)) AS page FROM demo_documents) SELECT document, CAST(page AS BIGINT) AS page FROM p LEFT JOIN s ON s.document_id = p.document WHERE NOT coalesce(list_contains(seen, page), false)")
def _(spark, d):
    seen = table(spark, d, "chunk_records").select(F.col("document_id").alias("document"), F.explode(F.col("pages").cast("array<bigint>")).alias("page")).distinct()
    pages = table(spark, d, "demo_documents").where("page_count >= 1").select("document", F.explode(F.sequence(F.lit(1), "page_count").cast("array<bigint>")).alias("page"))
    return pages.join(seen, ["document", "page"], "left_anti")
