"""Queries of classifiers, rules, workflows and evaluation sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import guards as G
from codexa.operators import policy as P
from codexa.plans.registry import query
from codexa.sources.tables import table

_SIGNALS = {"policy": {"coverage policy": 3.0, "deductible": 1.0, "medically necessary": 2.0}, "form": {"signature": 3.0, "date of birth": 3.0, "print clearly": 2.0}}


@query("cls1_document_router", """WITH s AS (SELECT DISTINCT chunk_id, lower(text) AS t FROM chunk_records), p AS (SELECT chunk_id, 3.0 * CAST(contains(t, 'coverage policy') AS INTEGER) + CAST(contains(t, 'deductible') AS INTEGER) + 2.0 * CAST(contains(t, 'medically necessary') AS INTEGER) AS a, 3.0 * CAST(contains(t, 'signature') AS INTEGER) + 3.0 * CAST(contains(t, 'date of birth') AS INTEGER) + 2.0 * CAST(contains(t, 'print clearly') AS INTEGER) AS b FROM s)
SELECT chunk_id, CASE WHEN a >= 4 THEN 'policy' WHEN b >= 4 THEN 'form' ELSE 'other' END AS route, CAST(CASE WHEN a >= 4 THEN a WHEN b >= 4 THEN b ELSE 0 END AS DOUBLE) AS score FROM p""")
def _(spark, d):
    c = table(spark, d, "chunk_records").select("chunk_id", "text").distinct()
    return c.select("chunk_id", P.weighted_route(F.col("text"), _SIGNALS, {"policy": 4, "form": 4}, "other").alias("r")).select("chunk_id", "r.route", "r.score")


@query("cls2_query_router", """WITH q AS (SELECT item_id, ' ' || regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM eval_items), s AS (SELECT item_id, 1.35 * CAST(contains(t, ' how many ') AS INTEGER) + CAST(contains(t, ' limit ') AS INTEGER) AS a, CAST(contains(t, ' form ') AS INTEGER) + CAST(contains(t, ' stamps ') AS INTEGER) AS b FROM q)
SELECT item_id, CASE WHEN greatest(a, b) = 0 THEN 'research' WHEN a = greatest(a, b) THEN 'counts' ELSE 'forms' END AS route, round(CASE WHEN greatest(a, b) = 0 THEN 0 ELSE exp(least(greatest(a, b), 8.0)) / (exp(least(a, 8.0)) + exp(least(b, 8.0))) END, 6) AS p FROM s""")
def _(spark, d):
    r = P.softmax_route(F.col("question"), {"counts": ["how many", "limit"], "forms": ["form", "stamps"]}, "research")
    return table(spark, d, "eval_items").select("item_id", r.alias("r")).select("item_id", "r.route", F.round("r.p", 6).alias("p"))


@query("cls3_route_guardrails", r"SELECT item_id, CASE WHEN regexp_matches(question, '\bD[0-9]{4}\b') THEN 'codes' WHEN contains(lower(question), 'how many') THEN 'counts' ELSE 'research' END AS route FROM eval_items")
def _(spark, d):
    q = F.col("question")
    return table(spark, d, "eval_items").select("item_id", F.when(q.rlike(r"\bD[0-9]{4}\b"), "codes").when(F.lower(q).contains("how many"), "counts").otherwise("research").alias("route"))


@query("cls4_catalog_classes", "SELECT id, CASE WHEN contains(lower(title), 'limits') THEN 'limits' WHEN contains(lower(title), 'appeal') THEN 'appeals' WHEN title IS NULL THEN 'untitled' ELSE 'guide' END AS kind, year(updated) < year(published) AS backdated FROM rag_documents")
def _(spark, d):
    t = F.lower("title")
    kind = F.when(t.contains("limits"), "limits").when(t.contains("appeal"), "appeals").when(F.col("title").isNull(), "untitled").otherwise("guide")
    return table(spark, d, "rag_documents").select("id", kind.alias("kind"), (F.year("updated") < F.year("published")).alias("backdated"))


@query("cls6_benefit_questions", r"SELECT item_id, regexp_matches(lower(question), 'cover|visits|copay|share') AND regexp_matches(question, '\?\s*$|^(What|Which|How|Does)') AS benefit FROM eval_items")
def _(spark, d):
    q = F.col("question")
    return table(spark, d, "eval_items").select("item_id", (F.lower(q).rlike("cover|visits|copay|share") & q.rlike(r"\?\s*$|^(What|Which|How|Does)")).alias("benefit"))


@query("cls7_tri_state_rules", "SELECT document_id, run_id, created_at, coalesce(CASE WHEN median_words IS NULL THEN NULL WHEN median_words > 150 THEN 'long' WHEN median_words < 50 THEN 'short' END, 'undecided') AS rule FROM (SELECT DISTINCT * FROM document_stats)")
def _(spark, d):
    m = F.col("median_words")
    return table(spark, d, "document_stats").distinct().select("document_id", "run_id", "created_at", F.coalesce(F.when(m > 150, "long").when(m < 50, "short"), F.lit("undecided")).alias("rule"))


@query("cls8_quality_score", "SELECT id, round((CAST(title IS NOT NULL AS INTEGER) + CAST(len(authors) > 0 AS INTEGER) + coalesce(CAST(updated >= published AS INTEGER), 0)) / (2.0 + CAST(updated >= published IS NOT NULL AS INTEGER)), 4) AS score FROM rag_documents WHERE authors IS NOT NULL")
def _(spark, d):
    r = table(spark, d, "rag_documents").where("authors IS NOT NULL")
    return r.select("id", P.quality_score([F.col("title").isNotNull(), F.size("authors") > 0, F.col("updated") >= F.col("published")]).alias("score"))


#: The guard in SQL, for engines without lookarounds.
_LUHN = "list_sum([CASE WHEN (len(x) - i) % 2 = 1 THEN 2 * CAST(x[i] AS INT) - CASE WHEN CAST(x[i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(x[i] AS INT) END for i in range(1, len(x) + 1)]) % 10 = 0"
_CARDS = rf"len([x for x in [regexp_replace(y, '[ -]', '', 'g') for y in regexp_extract_all(text, '\b[0-9](?:[ -]?[0-9]){{12,18}}\b')] if len(list_distinct(string_split(x, ''))) > 1 AND {_LUHN}]) > 0"
_SSN = r"len([x for x in regexp_extract_all(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b') if x[1:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:] <> '0000']) > 0"
_BLOCKED = f"CASE WHEN regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in G.INJECTION)}') THEN 'prompt_injection' WHEN {_SSN} THEN 'ssn' WHEN {_CARDS} THEN 'payment_card' {' '.join(f"WHEN regexp_matches(text, '{p}') THEN 'secret:{n}'" for n, p in G.SECRETS.items())} END"
_PERSONAL = r"regexp_matches(text, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b|(?i:\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b)|(^|[^0-9])(?:\+?1[-. ]*)?\(?[0-9]{3}[-. )]*[0-9]{3}[-. ]*[0-9]{4}($|[^0-9])')"


@query("cls9_guard_verdicts", f"WITH g AS (SELECT doc_id, text, {_BLOCKED} AS reason FROM documents WHERE text IS NOT NULL) SELECT doc_id, reason IS NULL AS allowed, coalesce(reason, CASE WHEN {_PERSONAL} THEN 'redacted' ELSE 'ok' END) AS category FROM g")
def _(spark, d):
    v = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", G.verdict("text").alias("v"))
    return v.select("doc_id", "v.allowed", "v.category")


_RULES = [{"tool": "click", "args": 're:"k": [0-4]}', "decision": "deny"}, {"tool": "view*", "decision": "allow"}, {"tool": "purchase", "agent": "1*", "decision": "allow"}, {"tool": "error", "decision": "deny"}]


@query("cls10_access_policy", """SELECT event_id, CASE WHEN event_type = 'click' AND regexp_matches(props, '"k": [0-4]}') THEN 'deny' WHEN starts_with(event_type, 'view') THEN 'allow' WHEN event_type = 'purchase' AND starts_with(CAST(user_id AS VARCHAR), '1') THEN 'allow' WHEN event_type = 'error' THEN 'deny' ELSE 'ask' END AS decision FROM events""")
def _(spark, d):
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("tool"), F.col("user_id").cast("string").alias("agent"), F.col("props").alias("args"))
    return P.access_decisions(calls, _RULES).select("event_id", "decision")


@query("cls11_unmet_requirements", "SELECT id, concat_ws(',', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN coalesce(len(authors), 0) = 0 THEN 'authors' END, CASE WHEN published IS NULL THEN 'published' END) AS unmet FROM rag_documents")
def _(spark, d):
    u = P.unmet({"title": F.col("title").isNotNull(), "authors": F.coalesce(F.size("authors"), F.lit(0)) > 0, "published": F.col("published").isNotNull()})
    return table(spark, d, "rag_documents").select("id", F.array_join(u, ",").alias("unmet"))


@query("cls12_action_matrix", "SELECT event_type, CAST(count(*) FILTER (value > 50) AS BIGINT) AS high, CAST(count(*) FILTER (value <= 50) AS BIGINT) AS low FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("level", F.when(F.col("value") > 50, "high").otherwise("low"))
    return e.groupBy("event_type").pivot("level", ["high", "low"]).agg(F.count("event_id")).fillna(0)


@query("cls13_14_page_classes", r"SELECT DISTINCT chunk_id, CASE WHEN content_type = 'table_row' THEN 'table' WHEN len(regexp_extract_all(text, '[0-9]+%')) >= 5 THEN 'chart' WHEN len(regexp_extract_all(text, '_{4,}')) >= 2 THEN 'form' ELSE 'narrative' END AS kind FROM chunk_records")
def _(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    kind = F.when(F.col("content_type") == "table_row", "table").when(n("[0-9]+%") >= 5, "chart").when(n("_{4,}") >= 2, "form").otherwise("narrative")
    return table(spark, d, "chunk_records").select("chunk_id", kind.alias("kind")).distinct()


@query("cls15_table_pages", r"SELECT DISTINCT chunk_id FROM chunk_records WHERE regexp_matches(text, '(?m)^\|.*\|$')")
def _(spark, d):
    return table(spark, d, "chunk_records").where(F.col("text").rlike(r"(?m)^\|.*\|$")).select("chunk_id").distinct()


@query("cls16_label_margin", "WITH s AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS r FROM s), g AS (SELECT user_id, max(CASE WHEN r = 1 THEN event_type END) AS l, max(CASE WHEN r = 1 THEN p END) AS a, max(CASE WHEN r = 2 THEN p END) AS b FROM r GROUP BY 1) SELECT user_id, CASE WHEN l = 'error' OR a < 0.2 THEN 'none' WHEN a - coalesce(b, 0) < 0.05 THEN 'ambiguous' ELSE l END AS decision FROM g")
def _(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    return P.label_with_margin(s, "user_id", "event_type", "p", "error", 0.2, 0.05)


@query("cls17_disagreement", "SELECT id, coalesce(primary_category, categories[1]) AS category, CASE WHEN primary_category IS NOT NULL THEN 'primary' WHEN categories[1] IS NOT NULL THEN 'secondary' ELSE 'none' END AS origin, coalesce(primary_category <> categories[1], false) AS disagree FROM rag_documents")
def _(spark, d):
    """The first classifier's word, else the second's; where both speak and differ, that is noted."""
    a, b = F.col("primary_category"), F.get("categories", F.lit(0))
    origin = F.when(a.isNotNull(), "primary").when(b.isNotNull(), "secondary").otherwise("none")
    return table(spark, d, "rag_documents").select("id", F.coalesce(a, b).alias("category"), origin.alias("origin"), F.coalesce(a != b, F.lit(False)).alias("disagree"))


@query("cls18_sanitised", r"SELECT item_id FROM eval_items WHERE NOT regexp_matches(passage, '\b(Oqu|Xor)[a-z]+\b')")
def _(spark, d):
    return table(spark, d, "eval_items").where(~F.col("passage").rlike(r"\b(Oqu|Xor)[a-z]+\b")).select("item_id")


@query("eva5_evidence_recall", "SELECT item_id, len(list_filter(regexp_extract_all(question, '[A-Z][a-z]{4,}'), lambda x: contains(passage, x))) / greatest(len(regexp_extract_all(question, '[A-Z][a-z]{4,}')), 1) AS share FROM eval_items")
def _(spark, d):
    names = F.regexp_extract_all("question", F.lit("[A-Z][a-z]{4,}"), F.lit(0))
    return table(spark, d, "eval_items").select("item_id", (F.size(F.filter(names, lambda x: F.col("passage").contains(x))) / F.greatest(F.size(names), F.lit(1))).alias("share"))


@query("eva6_facts_present", "SELECT item_id, contains(regexp_replace(lower(passage), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(answer), '[^a-z0-9]+', '', 'g')) AS present FROM eval_items WHERE answer IS NOT NULL")
def _(spark, d):
    return table(spark, d, "eval_items").where("answer IS NOT NULL").select("item_id", X.squeezed("passage").contains(X.squeezed("answer")).alias("present"))


@query("eva7_context_metrics", "SELECT document_id, CAST(count(*) AS BIGINT) AS units, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(ceil(length(content) / 4.0)) AS BIGINT) AS tokens FROM rag_chunks WHERE content IS NOT NULL GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "rag_chunks").where("content IS NOT NULL")
    return c.groupBy("document_id").agg(F.count("*").alias("units"), F.sum(F.length("content")).alias("chars"), F.sum(X.token_estimate("content")).alias("tokens"))


@query("eva8_set_precision", "SELECT id, round(len(list_intersect(list_distinct(categories), ['vision', 'claims'])) / greatest(len(list_distinct(categories)), 1), 6) AS precision FROM rag_documents WHERE categories IS NOT NULL")
def _(spark, d):
    c = F.array_distinct("categories")
    return table(spark, d, "rag_documents").where("categories IS NOT NULL").select("id", F.round(F.size(F.array_intersect(c, F.array(F.lit("vision"), F.lit("claims")))) / F.greatest(F.size(c), F.lit(1)), 6).alias("precision"))


@query("eva9_code_contamination", r"SELECT id, CAST(len(list_filter(list_distinct(regexp_extract_all(content, '\bD[0-9]{4}\b')), lambda x: x > 'D5000')) AS BIGINT) AS outside FROM rag_chunks WHERE content IS NOT NULL")
def _(spark, d):
    codes = F.array_distinct(X.found("content", r"\bD[0-9]{4}\b"))
    return table(spark, d, "rag_chunks").where("content IS NOT NULL").select("id", F.size(F.filter(codes, lambda x: x > "D5000")).cast("bigint").alias("outside"))


@query("eva10_outcome_matrix", "WITH f AS (SELECT item_type, contains(lower(passage), lower(answer)) AS c, contains(lower(question), lower(answer)) AS a FROM eval_items WHERE answer IS NOT NULL) SELECT item_type, CAST(count(*) FILTER (c AND a) AS BIGINT) AS both, CAST(count(*) FILTER (c AND NOT a) AS BIGINT) AS context_only, CAST(count(*) FILTER (NOT c AND a) AS BIGINT) AS answer_only, CAST(count(*) FILTER (NOT c AND NOT a) AS BIGINT) AS neither FROM f GROUP BY 1")
def _(spark, d):
    """A fact is in the context, in what was said, in both or in neither; the item's question stands for what was said."""
    f = table(spark, d, "eval_items").where("answer IS NOT NULL")
    f = f.select("item_type", F.lower("passage").contains(F.lower("answer")).alias("c"), F.lower("question").contains(F.lower("answer")).alias("a"))
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return f.groupBy("item_type").agg(n("c AND a", "both"), n("c AND NOT a", "context_only"), n("NOT c AND a", "answer_only"), n("NOT c AND NOT a", "neither"))


@query("eva12_field_scores", """WITH r AS (UNPIVOT (SELECT id, title, source, primary_category AS category FROM rag_documents) ON title, source, category INTO NAME field VALUE v), g AS (UNPIVOT (SELECT id, trim(title) AS title, lower(source) AS source, categories[1] AS category FROM rag_documents WHERE updated IS NOT NULL) ON title, source, category INTO NAME field VALUE v)
SELECT field, CASE WHEN g.v IS NULL THEN 'unasked' WHEN r.v IS NULL THEN 'missing' WHEN r.v = g.v THEN 'correct' ELSE 'wrong' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM r FULL JOIN g USING (id, field) GROUP BY ALL""")
def _(spark, d):
    """Fields of a result against those of a gold record, each by itself."""
    t = table(spark, d, "rag_documents")

    def fields(df, **cols):
        flat = df.select("id", F.explode(F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c)])).alias("field", "v"))
        return flat.where("v IS NOT NULL")

    r = fields(t, title=F.col("title"), source=F.col("source"), category=F.col("primary_category"))
    g = fields(t.where("updated IS NOT NULL"), title=F.trim("title"), source=F.lower("source"), category=F.get("categories", F.lit(0))).withColumnRenamed("v", "g")
    outcome = F.when(F.col("g").isNull(), "unasked").when(F.col("v").isNull(), "missing").when(F.col("v") == F.col("g"), "correct").otherwise("wrong")
    return r.join(g, ["id", "field"], "full_outer").groupBy("field", outcome.alias("outcome")).agg(F.count("*").alias("n"))


_CASES = {"sealants": ("sealant", "month"), "hearing": ("hearing", "visit"), "crowns": ("crown", "network", "plan")}


@query("eva13_suite_tallies", f"""WITH p AS (SELECT document_id, page_number AS page, {', '.join(f"{' AND '.join(f"bool_or(contains(lower(content), '{w}'))" for w in ws)} AS {k}" for k, ws in _CASES.items())} FROM rag_chunks WHERE content IS NOT NULL AND page_number IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) AS place FROM p), c AS ({' UNION ALL '.join(f"SELECT '{k}' AS name, document_id, min(place) FILTER ({k}) AS first FROM r GROUP BY 2" for k in _CASES)})
SELECT name, CAST(count(first) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS documents, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM c GROUP BY 1""")
def _(spark, d):
    """Cases of several facts: a document's pages in order, the first page that holds all facts of a case, and the mean of one over its place."""
    c = table(spark, d, "rag_chunks").where("content IS NOT NULL AND page_number IS NOT NULL")
    has = lambda ws: [F.max(F.lower("content").contains(w)) for w in ws]
    pages = c.groupBy("document_id", F.col("page_number").alias("page")).agg(*[reduce(lambda a, b: a & b, has(ws)).alias(k) for k, ws in _CASES.items()])
    r = pages.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("page")))  # one row a page
    firsts = r.groupBy("document_id").agg(*[F.min(F.when(F.col(k), F.col("place"))).alias(k) for k in _CASES])
    flat = firsts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("first")) for k in _CASES])).alias("x")).select("x.name", "x.first")
    return flat.groupBy("name").agg(F.count("first").alias("hits"), F.count("*").alias("documents"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("eva14_group_split", "SELECT DISTINCT chunk_id, document_id, CASE WHEN CAST('0x' || substring(md5('7:' || CAST(document_id AS VARCHAR)), 1, 15) AS BIGINT) % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM chunk_records")
def _(spark, d):
    """Train and test by whole documents: a seeded hash of the document decides, so no group is in both."""
    part = F.when(X.seeded(7, "document_id") % 10 < 8, "train").otherwise("test")
    return table(spark, d, "chunk_records").select("chunk_id", "document_id", part.alias("split")).distinct()


@query("eva15_training_rows", "WITH r AS (SELECT *, row_number() OVER (ORDER BY CAST('0x' || substring(md5('3:' || CAST(item_id AS VARCHAR)), 1, 15) AS BIGINT), item_id) AS r, count(*) OVER () AS n FROM eval_items), w AS (SELECT a.item_id, a.question, a.answer, a.passage, list_sort(list_distinct(list(b.passage))) AS o FROM r a JOIN r b ON b.r = a.r % a.n + 1 OR b.r = (a.r + 1) % a.n + 1 GROUP BY ALL) SELECT item_id, unnest(['direct', 'reasoned']) AS task, question, answer, array_to_string(list_concat([passage], o), ' | ') AS contexts FROM w")
def _(spark, d):
    """Each item with two distractor passages drawn by hash order, as rows for two tasks."""
    e = table(spark, d, "eval_items")
    n = e.count()
    ring = e.select("item_id", "question", "answer", "passage", F.row_number().over(Window.orderBy(X.seeded(3, "item_id"), "item_id")).alias("r"))  # the items are one small, stated set
    other = ring.select(F.col("r").alias("o"), F.col("passage").alias("distractor"))
    want = ring.select("*", F.explode(F.array((F.col("r") % n) + 1, ((F.col("r") + 1) % n) + 1)).alias("o"))
    g = want.join(other, "o").groupBy("item_id").agg(F.first("question").alias("question"), F.first("answer").alias("answer"), F.first("passage").alias("passage"), F.array_sort(F.collect_set("distractor")).alias("distractors"))
    return g.select("item_id", F.explode(F.array(F.lit("direct"), F.lit("reasoned"))).alias("task"), "question", "answer", F.array_join(F.concat(F.array("passage"), "distractors"), " | ").alias("contexts"))


@query("eva16_evidence_sentences", r"""WITH s AS (SELECT item_id, question, unnest(string_split_regex(passage, '\. ')) AS s FROM eval_items), o AS (SELECT item_id, s, len(list_intersect(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')))) AS k FROM s WHERE length(s) >= 15), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, s) AS r FROM o) SELECT item_id, s AS sentence FROM r WHERE r <= 2""")
def _(spark, d):
    s = table(spark, d, "eval_items").select("item_id", "question", F.explode(F.split("passage", r"\. ")).alias("sentence")).where(F.length("sentence") >= 15)
    k = F.size(F.array_intersect(F.array_distinct(X.tokens_alnum("sentence")), F.array_distinct(X.tokens_alnum("question"))))
    w = Window.partitionBy("item_id").orderBy(F.desc("k"), "sentence")
    return s.withColumn("k", k).withColumn("r", F.row_number().over(w)).where("r <= 2").select("item_id", "sentence")


@query("eva17_sampled_questions", "SELECT document_id, arg_min(id, CAST('0x' || substring(md5('11:' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT)) AS id FROM rag_chunks WHERE length(content) >= 200 GROUP BY 1")
def _(spark, d):
    """One long chunk a document, drawn by hash order."""
    c = table(spark, d, "rag_chunks").where(F.length("content") >= 200)
    return c.groupBy("document_id").agg(F.min_by("id", X.seeded(11, "id")).alias("id"))


@query("eva18_context_levels", "SELECT item_id, CASE WHEN k >= 8 THEN 'full' WHEN k >= 5 THEN 'long' WHEN k >= 3 THEN 'short' ELSE 'hide' END AS level FROM (SELECT item_id, len(list_intersect(list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')))) AS k FROM eval_items)")
def _(spark, d):
    k = F.size(F.array_intersect(F.array_distinct(X.tokens_alnum("passage")), F.array_distinct(X.tokens_alnum("question"))))
    return table(spark, d, "eval_items").select("item_id", F.when(k >= 8, "full").when(k >= 5, "long").when(k >= 3, "short").otherwise("hide").alias("level"))


def _registry() -> P.Registry:
    r = P.Registry()
    r.add("filter_type", lambda df, event_type: df.where(F.col("event_type") == event_type), {"event_type": str}, "approved")
    r.add("count_by", lambda df, column: df.groupBy(column).agg(F.count("*").alias("n")), {"column": str}, "approved")
    r.add("at_least", lambda df, n: df.where(F.col("n") >= n), {"n": int}, "approved")
    return r


@query("udf1_4_workflow", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 15")
def _(spark, d):
    """A JSON workflow of registered operations, validated before anything runs."""
    r = _registry()
    spec = '[{"id": "buys", "op": "filter_type", "params": {"event_type": "purchase"}}, {"id": "per", "op": "count_by", "input": "buys", "params": {"column": "user_id"}}, {"id": "many", "op": "at_least", "input": "per", "params": {"n": 15}}]'
    return P.run_spec(P.validated_spec(spec, r), table(spark, d, "events"), r)["many"]


@query("udf11_value_checks", "SELECT item_id, answer IS NOT NULL AND trim(answer) <> '' AS filled, regexp_matches(answer, '^[0-9]+ percent$') AS percent FROM eval_items")
def _(spark, d):
    a = F.col("answer")
    checks = {"filled": a.isNotNull() & (F.trim(a) != ""), "percent": a.rlike("^[0-9]+ percent$")}
    return table(spark, d, "eval_items").select("item_id", *[c.alias(n) for n, c in checks.items()])
