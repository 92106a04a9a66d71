"""Queries of event logs: streams drained over a table's file, and replays in batch."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from codexa.plans.registry import query
from codexa.sources.tables import table
from codexa.streaming import events as E


def _runs(df):
    """Each user's events as requests to move a run."""
    want = F.element_at(F.create_map(*map(F.lit, ("view", "queued", "signup", "queued", "click", "running", "purchase", "done", "error", "failed"))), F.col("event_type"))
    return df.select("user_id", "event_id", "ts", want.alias("wanted"))


_MOVED = "(({0} IS NULL AND e.wanted IN ('queued', 'running')) OR ({0} = 'queued' AND e.wanted IN ('running', 'cancelled')) OR ({0} = 'running' AND e.wanted IN ('done', 'failed', 'cancelled')))"
_STATES = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'queued' WHEN event_type = 'click' THEN 'running' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'error' THEN 'failed' END AS wanted, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT e.user_id, e.i, e.event_id, e.wanted, false AS accepted, CAST(NULL AS VARCHAR) AS state, 0 AS version FROM (SELECT DISTINCT user_id, 0 AS i, CAST(0 AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS wanted FROM e) e
UNION ALL SELECT e.user_id, e.i, e.event_id, e.wanted, coalesce({_MOVED.format('r.state')}, false), CASE WHEN coalesce({_MOVED.format('r.state')}, false) THEN e.wanted ELSE r.state END, r.version + CASE WHEN coalesce({_MOVED.format('r.state')}, false) THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS key, event_id AS event, wanted, accepted, state, CAST(version AS BIGINT) AS version FROM r WHERE i > 0"""


@query("str1_run_states", _STATES)
def _(spark, d):
    return E.run_states_batch(_runs(table(spark, d, "events")), "user_id", "event_id", "wanted", "ts")


@query("str1_stream_run_states", _STATES)
def _(spark, d):
    stream = _runs(E.parquet_stream(spark, d, "events"))
    return E.drained(E.run_states(stream, "user_id", "event_id", "wanted", "ts"), f"runs_{uuid.uuid4().hex}")


@query("str2_event_sequence", "SELECT user_id, CAST(max(seq) AS BIGINT) AS last_seq FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("seq", F.row_number().over(w)).groupBy("user_id").agg(F.max("seq").cast("bigint").alias("last_seq"))


@query("str3_stream_windows", "SELECT date_trunc('day', ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    w = E.windowed_counts(E.parquet_stream(spark, d, "events"), "ts", "event_type")
    return E.drained(w, f"win_{uuid.uuid4().hex}", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str4_6_stream_deduplicated", "SELECT DISTINCT event_id FROM events")
def _(spark, d):
    e = E.parquet_stream(spark, d, "events").select("event_id", "ts")
    return E.drained(E.first_deliveries(e.unionByName(e), ["event_id"], "ts"), f"dd_{uuid.uuid4().hex}").select("event_id")


@query("str5_bad_records", "SELECT event_id FROM events WHERE NOT coalesce(value > 1 AND event_type <> 'error', false)")
def _(spark, d):
    return E.split_bad(table(spark, d, "events"), (F.col("value") > 1) & (F.col("event_type") != "error"))[1].select("event_id")


@query("str7_version_conflicts", """WITH RECURSIVE e AS (SELECT user_id, event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) % 8 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, false AS accepted, CAST(0 AS BIGINT) AS version FROM e UNION ALL SELECT e.user_id, e.i, e.event_id, e.expected = r.version, r.version + CASE WHEN e.expected = r.version THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id AS key, event_id AS event, accepted, version FROM r WHERE i > 0""")
def _(spark, d):
    """Updates that name the version they were made on; those made on an old one are conflicts."""
    expected = F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)) % 8
    return E.versioned_updates(table(spark, d, "events").withColumn("expected", expected), "user_id", "event_id", "expected", "ts")


@query("str8_slot_filling", "WITH s AS (SELECT user_id, bool_or(event_type = 'signup') AS a, bool_or(event_type = 'view' AND value > 95) AS b, bool_or(event_type = 'purchase' AND value > 97) AS c FROM events GROUP BY 1) SELECT user_id, CASE WHEN NOT a THEN 'signup' WHEN NOT b THEN 'view' WHEN NOT c THEN 'purchase' ELSE 'review' END AS stage FROM s")
def _(spark, d):
    any_ = lambda c: F.max(F.expr(c))
    s = table(spark, d, "events").groupBy("user_id").agg(any_("event_type = 'signup'").alias("a"), any_("event_type = 'view' AND value > 95").alias("b"), any_("event_type = 'purchase' AND value > 97").alias("c"))
    return s.select("user_id", F.when(~F.col("a"), "signup").when(~F.col("b"), "view").when(~F.col("c"), "purchase").otherwise("review").alias("stage"))


@query("str10_13_remaining_work", "SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM chunk_records) WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_records WHERE contextualized_text IS NOT NULL)")
def _(spark, d):
    c = table(spark, d, "chunk_records")
    return c.select("chunk_id").distinct().join(c.where("contextualized_text IS NOT NULL").select("chunk_id"), "chunk_id", "left_anti")


_DECIDED = "CASE WHEN count(*) FILTER (event_type = 'error'{0}) >= 12 THEN 'review' WHEN sum(CASE WHEN event_type = 'purchase'{0} THEN value ELSE 0 END) >= 600 THEN 'accept' ELSE 'ask' END"


@query("str11_trace_replay", f"WITH l AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) SELECT user_id, {_DECIDED.format(' AND ts < last')} AS recorded, {_DECIDED.format('')} AS replayed FROM l GROUP BY 1")
def _(spark, d):
    """What was decided on a trace before its last record, and what the same rules decide on all of it."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))

    def decided(kept):
        errors = F.count_if((F.col("event_type") == "error") & kept)
        paid = F.sum(F.when((F.col("event_type") == "purchase") & kept, F.col("value")).otherwise(0.0))
        return F.when(errors >= 12, "review").when(paid >= 600, "accept").otherwise("ask")

    return e.join(last, "user_id").groupBy("user_id").agg(decided(F.col("ts") < F.col("last")).alias("recorded"), decided(F.lit(True)).alias("replayed"))


@query("str12_frozen_levels", "SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS level FROM events GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("level"))


@query("str15_enrolment_tiers", "SELECT user_id, CASE WHEN count(DISTINCT event_type) >= 4 THEN 'family' WHEN count(DISTINCT event_type) >= 2 THEN 'couple' ELSE 'self' END AS tier FROM events WHERE value > 60 GROUP BY 1")
def _(spark, d):
    n = F.count_distinct("event_type")
    return table(spark, d, "events").where("value > 60").groupBy("user_id").agg(F.when(n >= 4, "family").when(n >= 2, "couple").otherwise("self").alias("tier"))


@query("str17_verdict_reuse", """WITH k AS (SELECT chunk_id, coalesce(contextualized_at, TIMESTAMP '1970-01-01') AS t0, source_sha256 || ':' || md5(coalesce(contextualized_text, '')) || ':judge-1' AS h, review_status AS v FROM chunk_records),
g AS (SELECT chunk_id, arg_min(h, (t0, h, coalesce(v, ''))) AS h0, arg_min(coalesce(v, ''), (t0, h, coalesce(v, ''))) AS v0, arg_max(h, (t0, h, coalesce(v, ''))) AS h1, count(*) AS n FROM k GROUP BY 1)
SELECT CASE WHEN n > 1 AND h0 = h1 AND v0 <> '' THEN v0 ELSE 'judge' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1""")
def _(spark, d):
    """An earlier verdict is kept where source, context and judge are the same; all others are to be judged."""
    v = F.coalesce("review_status", F.lit(""))
    h = F.concat_ws(":", "source_sha256", F.md5(F.coalesce("contextualized_text", F.lit(""))), F.lit("judge-1"))
    k = table(spark, d, "chunk_records").select("chunk_id", F.coalesce("contextualized_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("at"), h.alias("h"), v.alias("v"))
    order = F.struct("at", "h", "v")
    g = k.groupBy("chunk_id").agg(F.min_by("h", order).alias("h0"), F.min_by("v", order).alias("v0"), F.max_by("h", order).alias("h1"), F.count("*").alias("n"))
    kept = (F.col("n") > 1) & (F.col("h0") == F.col("h1")) & (F.col("v0") != "")
    return g.groupBy(F.when(kept, F.col("v0")).otherwise("judge").alias("verdict")).agg(F.count("*").alias("n"))


@query("str18_fingerprint", "SELECT source, CAST(sum(CAST('0x' || substring(md5(id || ':' || CAST(coalesce(length(title), 0) AS VARCHAR)), 1, 15) AS BIGINT)) % 1000000007 AS BIGINT) AS fingerprint, CAST(count(*) AS BIGINT) AS files FROM rag_documents GROUP BY 1")
def _(spark, d):
    """A sum of hashes, so that no source is ever gathered in one row and order doesn't matter."""
    line = F.concat("id", F.lit(":"), F.coalesce(F.length("title"), F.lit(0)).cast("string"))
    number = F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("decimal(38,0)")
    return table(spark, d, "rag_documents").groupBy("source").agg((F.sum(number) % 1000000007).cast("bigint").alias("fingerprint"), F.count("*").alias("files"))
