"""Queries of the scalar text functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import guards as G
from codexa.operators import predicates as P
from codexa.plans.registry import query
from codexa.sources.tables import table

B = lambda c: c.cast("bigint")


def _tokens(name: str, fn, sql_list: str, source: str = "rag_chunks", key: str = "id", col: str = "content") -> None:
    """A token function over a whole column: number of tokens, of distinct tokens, and the tokens joined."""
    sql = f"""SELECT {key}, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct, array_to_string(t, ' ') AS joined
FROM (SELECT {key}, {sql_list} AS t FROM {source} WHERE {col} IS NOT NULL)"""

    @query(name, sql)
    def run(spark, d):
        df = table(spark, d, source).where(F.col(col).isNotNull()).select(key, fn(col).alias("t"))
        return df.select(key, B(F.size("t")).alias("n_tokens"), B(F.size(F.array_distinct("t"))).alias("n_distinct"), F.array_join("t", " ").alias("joined"))


_tokens("scal1_tokens_hyphen", X.tokens_hyphen, "list_transform(regexp_extract_all(content, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda x: lower(x))")
_tokens("scal2_tokens_alnum", X.tokens_alnum, "regexp_extract_all(lower(content), '[a-z0-9]+')")
_tokens("scal3_tokens_numbers", X.tokens_numbers, "regexp_extract_all(lower(content), '[a-z0-9]+(?:[.,][0-9]+)*%?')")
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_tokens("scal4_tokens_content", X.tokens_content, f"list_filter(regexp_extract_all(lower(content), '[a-z0-9$%.-]+'), lambda x: x NOT IN ({_STOP}) AND regexp_matches(x, '[a-z0-9]'))")
_SYN = {"dentist": ["dental", "provider"], "bill": ["invoice", "claim"], "fee": ["charge"]}
_tokens(
    "scal5_query_expansion",
    lambda c: X.expanded(X.tokens_content(c), _SYN),
    f"flatten(list_transform(list_filter(regexp_extract_all(lower(question), '[a-z0-9$%.-]+'), lambda x: x NOT IN ({_STOP}) AND regexp_matches(x, '[a-z0-9]')), lambda x: CASE x WHEN 'dentist' THEN ['dentist', 'dental', 'provider'] WHEN 'bill' THEN ['bill', 'invoice', 'claim'] WHEN 'fee' THEN ['fee', 'charge'] ELSE [x] END))",
    "eval_items", "item_id", "question",
)


@query("scal6_long_words", f"SELECT id, CAST(len(list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z_0-9]{{4,}}'), lambda x: x NOT IN ({_STOP})))) AS BIGINT) AS n_words FROM rag_chunks WHERE content IS NOT NULL")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", B(F.size(X.long_words("content"))).alias("n_words"))


@query("scal7_squeezed", "SELECT item_id, regexp_replace(lower(question), '[^a-z0-9]+', '', 'g') AS squeezed FROM eval_items")
def _(spark, d):
    return table(spark, d, "eval_items").select("item_id", X.squeezed("question").alias("squeezed"))


@query("scal8_nfkc_words")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfkc_words("text").alias("words"))


@query("scal9_masked_lines", """SELECT masked, CAST(count(*) AS BIGINT) AS n FROM (SELECT regexp_replace(lower(trim(l)), '[0-9]+', '#', 'g') AS masked FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM (SELECT DISTINCT chunk_id, text FROM chunk_records))) WHERE masked <> '' GROUP BY masked""")
def _(spark, d):
    lines = table(spark, d, "chunk_records").select("chunk_id", "text").distinct().select(F.explode(F.split("text", "\n", -1)).alias("l"))
    return lines.select(X.masked_line("l").alias("masked")).where("masked <> ''").groupBy("masked").agg(F.count("*").alias("n"))


@query("scal10_plain_numbers", r"""SELECT item_id, regexp_replace(regexp_replace(lower(answer), '[%,\s]', '', 'g'), '(\.[0-9]*?)0+$|\.$', '\1', 'g') AS plain FROM eval_items WHERE answer IS NOT NULL""")
def _(spark, d):
    return table(spark, d, "eval_items").where("answer IS NOT NULL").select("item_id", X.plain_number("answer").alias("plain"))


@query("scal11_clean_lines", r"""SELECT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cleaned FROM rag_chunks""")
def _(spark, d):
    return table(spark, d, "rag_chunks").select("id", X.clean_lines("content").alias("cleaned"))


@query("scal12_plain_quotes", r"""SELECT id, regexp_replace(translate(content, '‘’“”', '''''""'), '\s+', ' ', 'g') AS plain FROM rag_chunks WHERE content IS NOT NULL""")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", X.plain_quotes("content").alias("plain"))


@query("scal13_no_markup", r"""SELECT chunk_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[*_`#>|]+', ' ', 'g'), '-{2,}', ' ', 'g'), '[ \t\n]+', ' ', 'g')) AS plain FROM (SELECT DISTINCT chunk_id, text FROM chunk_records)""")
def _(spark, d):
    return table(spark, d, "chunk_records").select("chunk_id", "text").distinct().select("chunk_id", X.no_markup("text").alias("plain"))


@query("scal14_slugs", "SELECT id, substring(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90) AS slug FROM rag_documents WHERE title IS NOT NULL")
def _(spark, d):
    return table(spark, d, "rag_documents").where("title IS NOT NULL").select("id", X.slug("title").alias("slug"))


@query("scal15_url_parts", """SELECT id, 'docs.example.org' AS host, '/files/' || id || '.pdf' AS path, 'p=1' AS query FROM rag_documents""")
def _(spark, d):
    url = F.concat(F.lit("https://docs.example.org/files/"), F.col("id"), F.lit(".pdf?p=1#top"))
    return table(spark, d, "rag_documents").select("id", F.parse_url(url, F.lit("HOST")).alias("host"), F.url_decode(F.parse_url(url, F.lit("PATH"))).alias("path"), F.parse_url(url, F.lit("QUERY")).alias("query"))


@query("scal16_last_year", "SELECT id, CAST(list_extract(regexp_extract_all(content, '20[0-9]{2}'), -1) AS INTEGER) AS year FROM rag_chunks")
def _(spark, d):
    return table(spark, d, "rag_chunks").select("id", X.last_year("content").alias("year"))


@query("scal17_version_ids", r"""SELECT document_version, CAST(regexp_extract(document_version, 'v([0-9]+)\.([0-9]+)', 1) AS INTEGER) AS major, CAST(regexp_extract(document_version, 'v([0-9]+)\.([0-9]+)', 2) AS INTEGER) AS minor, CAST(count(*) AS BIGINT) AS n FROM chunk_records WHERE regexp_matches(document_version, '^v[0-9]+\.[0-9]+$') GROUP BY ALL""")
def _(spark, d):
    v = F.col("document_version")
    part = lambda i: F.regexp_extract(v, r"(?<![0-9])v([0-9]+)\.([0-9]+)(?![0-9])", i).cast("int")
    return table(spark, d, "chunk_records").where(v.rlike(r"^v[0-9]+\.[0-9]+$")).groupBy(v, part(1).alias("major"), part(2).alias("minor")).agg(F.count("*").alias("n"))


@query("scal18_billing_codes", r"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '\b[A-Za-z][0-9]{4}\b'), lambda x: upper(x)))), ' ') AS codes FROM rag_chunks WHERE content IS NOT NULL""")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.array_join(F.sort_array(X.billing_codes("content")), " ").alias("codes"))


@query("scal19_code_routes", r"""SELECT item_id, regexp_matches(question, '\bD[0-9]{4}\b') AS has_code, CASE WHEN regexp_matches(question, '\bD[0-9]{4}\b') THEN 'bm25' ELSE 'hybrid' END AS mode FROM eval_items""")
def _(spark, d):
    hit = F.col("question").rlike(r"\bD\d{4}\b")
    return table(spark, d, "eval_items").select("item_id", hit.alias("has_code"), F.when(hit, "bm25").otherwise("hybrid").alias("mode"))


@query("scal20_numbers_in", r"""SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(content), '\$[0-9][0-9,]*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?%|\b[0-9]+[a-z]\b'), lambda x: replace(x, ',', '')))), ' ') AS numbers FROM rag_chunks WHERE content IS NOT NULL""")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.array_join(F.sort_array(X.numbers_in("content")), " ").alias("numbers"))


@query("scal21_named_targets", r"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(?:[A-Z]{2,}[0-9]*|[A-Z][a-z]+[A-Z][A-Za-z]+)\b')) AS name FROM documents) SELECT name, CAST(count(*) AS BIGINT) AS n_documents FROM n GROUP BY name""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.names_in("text")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n_documents"))


@query("scal22_contact_slots", r"""SELECT chunk_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0) AS email, regexp_extract(text, '\b[0-9]{3}-[0-9]{4}\b', 0) AS phone, regexp_extract(text, '\b[0-9]{5}-[0-9]{2}\b', 0) AS control FROM (SELECT DISTINCT chunk_id, text FROM chunk_records) WHERE regexp_matches(text, '\b[0-9]{3}-[0-9]{4}\b')""")
def _(spark, d):
    get = lambda p: F.regexp_extract("text", p, 0)
    rows = table(spark, d, "chunk_records").select("chunk_id", "text").distinct().where(F.col("text").rlike(r"\b[0-9]{3}-[0-9]{4}\b"))
    return rows.select("chunk_id", get(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("email"), get(r"\b[0-9]{3}-[0-9]{4}\b").alias("phone"), get(r"\b[0-9]{5}-[0-9]{2}\b").alias("control"))


_REDACT = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\b', '[SSN]', 'g'), '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[EMAIL]', 'g'), '(^|[^0-9])(?:\+?1[-. ]*)?\(?[0-9]{{3}}[-. )]*[0-9]{{3}}[-. ]*[0-9]{{4}}($|[^0-9])', '\1[PHONE]\2', 'g')"""
_CONTACT = "'Call 212-555-01' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ' or write ' || lower(c_name) || '@mail.example.org, ssn 123-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')"


@query("scal23_redaction", f"SELECT c_custkey, {_REDACT.format(_CONTACT.replace('lower(c_name)', 'replace(lower(c_name), chr(35), chr(45))'))} AS redacted FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    made = F.concat(F.lit("Call 212-555-01"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit(" or write "), F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit("@mail.example.org, ssn 123-45-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    return table(spark, d, "customer").select("c_custkey", G.redacted(made).alias("redacted"))


@query("scal24_scrubbed")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", G.scrubbed("text").alias("scrubbed"))


@query("scal25_short_hash", "SELECT c_custkey, 'sha256:' || substring(sha256(c_name), 1, 12) AS hashed FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.short_hash("c_name").alias("hashed"))


@query("scal26_content_ids", "SELECT id, sha256(content) AS digest, substring(sha1(content), 1, 12) AS key FROM rag_chunks WHERE content IS NOT NULL")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.sha2("content", 256).alias("digest"), F.substring(F.sha1("content"), 1, 12).alias("key"))


@query("scal27_seeded_hashes")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", *[F.xxhash64(F.lit(i), "content").alias(f"h{i}") for i in range(4)])


@query("scal28_check_digit", """SELECT code, CAST(list_sum(list_transform(range(0, 10), lambda i: (instr('0123456789A?BCDEFGHIJK?LMNOPQRSTU?VWXYZ', substring(code, CAST(i AS INTEGER) + 1, 1)) - 1) * CAST(power(2, i) AS BIGINT))) AS BIGINT) % 11 % 10 AS digit FROM (SELECT 'CSQU' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS code FROM customer)""")
def _(spark, d):
    code = F.concat(F.lit("CSQU"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return table(spark, d, "customer").select(code.alias("code")).select("code", X.container_check_digit("code").alias("digit"))


@query("scal29_cast_errors", """SELECT CAST(TRY_CAST(answer AS INTEGER) IS NULL AS INTEGER) AS bad_int, CAST(TRY_CAST(answer AS DATE) IS NULL AS INTEGER) AS bad_date, CAST(count(*) AS BIGINT) AS n FROM eval_items WHERE answer IS NOT NULL GROUP BY ALL""")
def _(spark, d):
    a = F.col("answer")
    return table(spark, d, "eval_items").where(a.isNotNull()).groupBy(a.try_cast("int").isNull().cast("int").alias("bad_int"), a.try_cast("date").isNull().cast("int").alias("bad_date")).agg(F.count("*").alias("n"))


@query("scal30_lenient_numbers", "SELECT item_id, TRY_CAST(regexp_replace(answer, '[^0-9.+-]', '', 'g') AS DOUBLE) AS number FROM eval_items WHERE answer IS NOT NULL")
def _(spark, d):
    return table(spark, d, "eval_items").where("answer IS NOT NULL").select("item_id", X.lenient_number("answer").alias("number"))


@query("scal31_time_differences", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(max(l_shipdate) AS DATE)) AS BIGINT) AS days, CAST(floor(epoch(max(l_shipdate) - o_orderdate) / 60) AS BIGINT) AS minutes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def _(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.max("l_shipdate").alias("s"))
    return j.select("o_orderkey", B(F.datediff("s", "o_orderdate")).alias("days"), F.expr("timestampdiff(MINUTE, o_orderdate, s)").alias("minutes"))


@query("scal32_half_open_year", "SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate >= make_date(1998, 1, 1) AND o_orderdate < make_date(1999, 1, 1) GROUP BY 1")
def _(spark, d):
    y = F.lit(1998)
    inside = (F.col("o_orderdate") >= F.make_date(y, F.lit(1), F.lit(1))) & (F.col("o_orderdate") < F.make_date(y + 1, F.lit(1), F.lit(1)))
    return table(spark, d, "orders").where(inside).groupBy(B(F.year("o_orderdate")).alias("y")).agg(F.count("*").alias("n"))


@query("scal33_token_estimate", "SELECT id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM rag_chunks WHERE content IS NOT NULL")
def _(spark, d):
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", X.token_estimate("content").alias("tokens"))


@query("scal34_cosine", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(list_dot_product(e, list_reverse(e)) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(e, e))), 5) AS similarity FROM v""")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(X.cosine("embedding", F.reverse("embedding")), 5).alias("similarity"))


@query("scal35_logistic_softmax", """SELECT document_id, run_id, round(1 / (1 + exp(-(chunks - 5.0) / 2.0)), 6) AS p, round(exp(least(tiny, 8.0)) / (exp(least(tiny, 8.0)) + exp(least(toc, 8.0)) + exp(least(form, 8.0))), 6) AS tiny_share FROM (SELECT DISTINCT document_id, run_id, created_at, chunks, tiny, toc, form FROM document_stats)""")
def _(spark, d):
    s = table(spark, d, "document_stats").select("document_id", "run_id", "created_at", "chunks", "tiny", "toc", "form").distinct()
    e = {c: F.exp(F.least(F.col(c).cast("double"), F.lit(8.0))) for c in ("tiny", "toc", "form")}
    return s.select("document_id", "run_id", F.round(X.logistic(F.col("chunks"), 5.0, 2.0), 6).alias("p"), F.round(e["tiny"] / (e["tiny"] + e["toc"] + e["form"]), 6).alias("tiny_share"))


@query("scal36_confidence_bands", "SELECT CASE WHEN p >= 0.85 THEN 'high' WHEN p >= 0.65 THEN 'medium' ELSE 'low' END AS band, CAST(count(*) AS BIGINT) AS n FROM (SELECT value / 100.0 AS p FROM events) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(X.confidence_band(F.col("value") / 100).alias("band")).agg(F.count("*").alias("n"))


@query("scal37_templates", "SELECT id, coalesce(title, '?') || ' (' || coalesce(primary_category, '?') || ', ' || coalesce(CAST(published AS VARCHAR), '?') || ')' AS line FROM rag_documents")
def _(spark, d):
    return table(spark, d, "rag_documents").select("id", X.template("{title} ({category}, {published})", title=F.col("title"), category=F.col("primary_category"), published=F.col("published")).alias("line"))


@query("scal38_json_access", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.none'), '-') AS missing FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("-")).alias("missing"))


@query("scal39_flattened_records", """SELECT id, 'authors[' || CAST(i - 1 AS VARCHAR) || ']' AS path, authors[i] AS value FROM (SELECT id, authors, unnest(range(1, len(authors) + 1)) AS i FROM rag_documents WHERE authors IS NOT NULL) UNION ALL SELECT id, 'source', source FROM rag_documents WHERE source IS NOT NULL""")
def _(spark, d):
    t = table(spark, d, "rag_documents")
    a = t.select("id", F.posexplode("authors").alias("i", "value")).select("id", F.concat(F.lit("authors["), F.col("i"), F.lit("]")).alias("path"), "value")
    return a.unionByName(t.where("source IS NOT NULL").select("id", F.lit("source").alias("path"), F.col("source").alias("value")))


@query("scal40_token_f1", """WITH q AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM eval_items) GROUP BY ALL), p AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS t FROM eval_items) GROUP BY ALL),
o AS (SELECT item_id, sum(least(q.n, p.n)) AS shared FROM q JOIN p USING (item_id, t) GROUP BY item_id), a AS (SELECT item_id, sum(n) AS n FROM q GROUP BY 1), b AS (SELECT item_id, sum(n) AS n FROM p GROUP BY 1)
SELECT a.item_id, round(2.0 * coalesce(shared, 0) / (a.n + b.n), 6) AS f1 FROM a JOIN b USING (item_id) LEFT JOIN o USING (item_id)""")
def _(spark, d):
    return P.token_f1(table(spark, d, "eval_items"), "item_id", "question", "passage")


@query("scal41_sequence_ratio")
def _(spark, d):
    return table(spark, d, "eval_items").select("item_id", F.round(X.sequence_ratio("question", "passage"), 6).alias("ratio"))
