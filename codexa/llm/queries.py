"""Queries and SQL of the training-data problems, by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexa.llm.consistent import LOOK_ALIKE, ZERO_WIDTH

#: Module of each query; a name is the function's own.
MODULES = {
    "scanned": ("p3_found", "p3_text"),
    "quality": ("p6_found", "p6_measures", "p6_documents"),
    "standing_lines": ("p1_found", "p1_text", "p1_boilerplate"),
    "consistent": ("p9_found", "p9_text"),
    "leakage": ("p8_found", "p8_items"),
    "splitting": ("p4_found", "p4_pieces"),
    "near_duplicates": ("p2_found", "p2_groups"),
    "packing": ("p7_containers",),
    "neighbours": ("p5_found", "p5_neighbours", "p5_copies"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: getattr(importlib.import_module(f"codexa.llm.{m}"), q) for m, qs in MODULES.items() for q in qs}


_RUNS3 = "list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)])"
_PASSAGES = r"""texts AS (
            SELECT 'content' AS field, CAST(id AS VARCHAR) AS key, content AS t FROM rag_chunks WHERE id IS NOT NULL AND content IS NOT NULL
            UNION ALL SELECT 'contextualized_text', chunk_id, contextualized_text FROM chunk_records WHERE chunk_id IS NOT NULL AND contextualized_text IS NOT NULL),
        words AS (SELECT field, key, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM texts)"""
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _words_of(column: str) -> str:
    """A column's words in one form: enough to compare both sides of a leak, as any letter that looks like a Latin one becomes it."""
    alike = "".join(LOOK_ALIKE), "".join(LOOK_ALIKE.values())
    plain = f"translate(translate(regexp_replace(coalesce({column}, ''), '[{ZERO_WIDTH}]', '', 'g'), '{alike[0]}', '{alike[1]}'), '{_WIDE[0]}', '{_WIDE[1]}')"
    return rf"regexp_extract_all(lower(nfc_normalize({plain})), '[\p{{L}}\p{{N}}]+')"


_RUNS12 = "list_distinct([array_to_string(w[i : i + 11], ' ') for i in range(1, len(w) - 10)])"
_LEAKS = f"""
        d AS (SELECT doc_id, {_words_of('text')} AS w FROM documents WHERE doc_id IS NOT NULL),
        i AS (SELECT item_id, {_words_of('question')} AS w, true AS whole FROM eval_items UNION ALL SELECT item_id, {_words_of('passage')}, false FROM eval_items),
        dr AS (SELECT doc_id, unnest({_RUNS12}) AS run FROM d), ir AS (SELECT item_id, unnest({_RUNS12}) AS run FROM i),
        short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS q FROM i WHERE whole AND len(w) BETWEEN 1 AND 11), flat AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
        found AS (SELECT doc_id, item_id FROM dr JOIN ir USING (run) UNION SELECT doc_id, item_id FROM flat JOIN short ON contains(t, q))"""

#: Where SQL says a problem's cases over whole tables without the operator's method.
SQL = {
    "p2_found": r"""
        WITH texts AS (
            SELECT 'content' AS field, CAST(id AS VARCHAR) AS key, content AS t FROM rag_chunks WHERE id IS NOT NULL AND content IS NOT NULL
            UNION SELECT 'contextualized_text', chunk_id, contextualized_text FROM chunk_records WHERE chunk_id IS NOT NULL AND contextualized_text IS NOT NULL),
        words AS (SELECT field, key, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM texts),
        runs AS (SELECT field, key, list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)]) AS r FROM words WHERE len(w) >= 40),
        flat AS (SELECT field, key, len(r) AS n, unnest(r) AS run FROM runs),
        hits AS (
            SELECT a.field, a.key AS key_a, b.key AS key_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
            FROM flat a JOIN flat b ON a.field = b.field AND a.run = b.run AND a.key < b.key AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY ALL)
        SELECT field, key_a, key_b FROM hits WHERE same >= 0.6 * (na + nb - same)""",
    "p2_groups": f"""
        WITH RECURSIVE {_PASSAGES},
        held AS (SELECT field, key, array_to_string(w, ' ') AS th, w FROM words WHERE len(w) >= 40),
        reps AS (SELECT field, th, min(key) AS rep, count(*) AS copies, any_value(w) AS w FROM held GROUP BY 1, 2),
        runs AS (SELECT field, rep, {_RUNS3} AS r FROM reps), flat AS (SELECT field, rep, len(r) AS n, unnest(r) AS run FROM runs),
        hits AS (
            SELECT a.field, a.rep AS ka, b.rep AS kb, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS same
            FROM flat a JOIN flat b ON a.field = b.field AND a.run = b.run AND a.rep <> b.rep AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY ALL),
        edges AS (SELECT field, ka, kb FROM hits WHERE same >= 0.6 * (na + nb - same)),
        reach AS (SELECT field, rep AS a, rep AS b FROM reps UNION SELECT r.field, r.a, e.kb FROM reach r JOIN edges e ON e.field = r.field AND e.ka = r.b),
        class AS (SELECT field, a AS rep, min(b) AS class_key FROM reach GROUP BY 1, 2), degree AS (SELECT field, ka AS rep, count(*) AS links FROM edges GROUP BY 1, 2)
        SELECT DISTINCT field, key, class_key, CAST(coalesce(links, 0) AS BIGINT) AS links, CAST(copies AS BIGINT) AS copies FROM held JOIN reps USING (field, th) JOIN class USING (field, rep) LEFT JOIN degree USING (field, rep)""",
    "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM found",
    "p8_items": f"WITH {_LEAKS} SELECT item_id, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_documents, min(doc_id) AS first_doc_id FROM found GROUP BY 1",
    "p5_copies": """
        WITH v AS (
            SELECT id, embedding AS e FROM rag_chunks
            WHERE id IS NOT NULL AND len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64 AND len([x for x in embedding if x <> 0]) > 0),
        g AS (SELECT e, min(id) AS rep FROM v GROUP BY e HAVING min(id) <> max(id))
        SELECT DISTINCT rep, id FROM v JOIN g USING (e)""",
    "p5_found": """
        WITH v AS (
            SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM rag_chunks
            WHERE id IS NOT NULL AND len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64 AND len([x for x in embedding if x <> 0]) > 0)
        SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say over whole tables; the rest is tested against brute force in tests/llm."""
    return dict(SQL)
