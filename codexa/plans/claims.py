"""Claims queries: suppliers are providers, customers patients, part types services, line prices what was paid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexa.functions import text as X
from codexa.operators import claims as C
from codexa.operators.ranges import numbered
from codexa.plans.registry import query
from codexa.sources.tables import table

_CLAIMS = """cl AS (SELECT l_orderkey * 10 + l_linenumber AS claim, o_custkey AS patient, l_suppkey AS provider, p_brand AS service, CAST(l_shipdate AS DATE) AS date, l_quantity AS minutes, round(l_extendedprice, 2) AS paid FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    j = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.col("o_custkey").alias("patient"), F.col("l_suppkey").alias("provider"), F.col("p_brand").alias("service"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("minutes"), F.round("l_extendedprice", 2).alias("paid"))


_EV = """ev AS (SELECT event_id AS claim, user_id AS patient, user_id % 20 AS provider, event_type AS service, CAST(ts AS DATE) AS date, ts AS start, value AS minutes, round(value, 0) AS paid FROM events)"""


def visits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("claim"), F.col("user_id").alias("patient"), (F.col("user_id") % 20).alias("provider"), F.col("event_type").alias("service"), F.to_date("ts").alias("date"), F.col("ts").alias("start"), F.col("value").alias("minutes"), F.round("value", 0).alias("paid"))


_SUMMARY = f"""WITH {_CLAIMS}, s AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY n DESC, service) AS r FROM (SELECT provider, service, count(*) AS n FROM cl GROUP BY provider, service)),
b AS (SELECT provider, count(*) AS claims, count(DISTINCT patient) AS patients, round(sum(paid), 2) AS total, round(avg(paid), 2) AS mean FROM cl GROUP BY 1)
SELECT provider, CAST(claims AS BIGINT) AS claims, CAST(patients AS BIGINT) AS patients, total, mean, service AS top_service, round(n / claims, 4) AS top_share FROM b JOIN s USING (provider) WHERE r = 1 AND claims >= 3"""


@query("agg1_provider_summary", _SUMMARY)
def _(spark, d):
    return C.provider_summary(claims(spark, d), 3)


@query("frd1_top_providers", _SUMMARY + " ORDER BY total DESC, provider LIMIT 10")
def _(spark, d):
    return C.provider_summary(claims(spark, d), 3).orderBy(F.desc("total"), "provider").limit(10)


@query("agg3_duplicate_groups", f"WITH {_CLAIMS}, g AS (SELECT patient, service, provider, count(*) AS n FROM cl WHERE paid > 0 GROUP BY ALL HAVING count(*) > 1) SELECT provider, CAST(count(*) AS BIGINT) AS groups, CAST(sum(n) AS BIGINT) AS claims FROM g GROUP BY 1")
def _(spark, d):
    g = claims(spark, d).where("paid > 0").groupBy("patient", "service", "provider").agg(F.count("*").alias("n")).where("n > 1")
    return g.groupBy("provider").agg(F.count("*").alias("groups"), F.sum("n").alias("claims"))


@query("agg4_daily_load", f"WITH {_EV} SELECT provider, date, CAST(count(*) AS BIGINT) AS claims, CAST(count(DISTINCT patient) AS BIGINT) AS patients, round(sum(minutes), 2) AS minutes, min(start) AS first_start, max(start) AS last_start FROM ev GROUP BY ALL ORDER BY round(sum(minutes), 2) DESC, provider, date LIMIT 50")
def _(spark, d):
    g = visits(spark, d).groupBy("provider", "date").agg(F.count("*").alias("claims"), F.count_distinct("patient").alias("patients"), F.round(F.sum("minutes"), 2).alias("minutes"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))
    return g.orderBy(F.desc("minutes"), "provider", "date").limit(50)


_LOO = f"""{_CLAIMS}, loo AS (SELECT a.provider, a.service, any_value(a.n) AS own_n, any_value(a.m) AS own_mean, count(*) AS peer_n, median(o.paid) AS peer_median FROM (SELECT provider, service, count(*) AS n, avg(paid) AS m FROM cl GROUP BY ALL) a JOIN cl o ON o.service = a.service AND o.provider <> a.provider GROUP BY a.provider, a.service)"""


@query("join18_leave_one_out", f"WITH {_LOO} SELECT service, provider, CAST(own_n AS BIGINT) AS own_n, round(own_mean, 6) AS own_mean, CAST(peer_n AS BIGINT) AS peer_n, round(peer_median, 4) AS peer_median FROM loo")
def _(spark, d):
    m = C.leave_one_out_median(claims(spark, d), "service", "provider", "paid")
    return m.select("service", "provider", "own_n", F.round("own_mean", 6).alias("own_mean"), "peer_n", F.round("peer_median", 4).alias("peer_median"))


@query("frd2_service_cost_vs_peers", f"WITH {_LOO} SELECT service, provider, round(own_mean / peer_median, 4) AS ratio FROM loo WHERE own_n >= 20 AND peer_median > 0")
def _(spark, d):
    m = C.leave_one_out_median(claims(spark, d), "service", "provider", "paid").where("own_n >= 20 AND peer_median > 0")
    return m.select("service", "provider", F.round(F.col("own_mean") / F.col("peer_median"), 4).alias("ratio"))


@query("frd3_peer_cost", f"""WITH {_LOO}, t AS (SELECT *, own_mean / peer_median AS ratio, row_number() OVER (PARTITION BY provider ORDER BY own_n DESC, service) AS r FROM loo), k AS (SELECT * FROM t WHERE r <= 15 AND own_n >= 3 AND peer_median > 0),
e AS (SELECT cl.provider, cl.service, sum(cl.paid - peer_median) AS excess FROM cl JOIN k USING (provider, service) WHERE cl.paid > 1.3 * peer_median GROUP BY ALL),
b AS (SELECT k.provider, k.service, ratio, excess, row_number() OVER (PARTITION BY k.provider ORDER BY round(ratio, 6) DESC, k.service) AS q FROM k LEFT JOIN e ON e.provider = k.provider AND e.service = k.service WHERE ratio > 1)
SELECT provider, service, round(ratio, 4) AS ratio, round(coalesce(excess, 0), 4) AS excess FROM b WHERE q = 1""")
def _(spark, d):
    return C.peer_cost(claims(spark, d))


@query("frd4_repeats", f"""WITH {_EV}, dd AS (SELECT patient, service, paid, provider, date, count(*) AS n FROM ev WHERE paid > 0 GROUP BY ALL),
g AS (SELECT *, date - lag(date) OVER w AS gap, lag(date) OVER w - lag(date, 2) OVER w AS gb, lead(date) OVER w - date AS ga FROM dd WINDOW w AS (PARTITION BY patient, service, paid, provider ORDER BY date)),
f AS (SELECT *, gap BETWEEN 1 AND 3 AS near, coalesce(gb, 9999) <= 7 OR coalesce(ga, 9999) <= 7 AS steady FROM g)
SELECT provider, CAST(sum(CAST(n > 1 AS INTEGER)) AS BIGINT) AS exact, CAST(sum(CASE WHEN near AND NOT steady THEN 1 ELSE 0 END) AS BIGINT) AS rebilled, CAST(sum(CASE WHEN near AND steady THEN 1 ELSE 0 END) AS BIGINT) AS routine, round(sum(CAST(n > 1 AS INTEGER)) + 0.5 * sum(CASE WHEN near AND NOT steady THEN 1 ELSE 0 END), 2) AS score FROM f GROUP BY 1""")
def _(spark, d):
    return C.repeats(visits(spark, d), 3).withColumn("score", F.round(F.col("score").cast("double"), 2))


_ENDS = "en AS (SELECT o_custkey AS patient, CAST(max(o_orderdate) AS DATE) - 200 AS ended FROM orders GROUP BY 1)"


@query("frd5_after_death", f"""WITH {_CLAIMS}, {_ENDS}, j AS (SELECT provider, date - ended AS days, service = 'Brand#11' AS x FROM cl JOIN en USING (patient) WHERE date > ended)
SELECT provider, CAST(sum(CAST(NOT x AS INTEGER)) AS BIGINT) AS n, CAST(sum(CAST(x AS INTEGER)) AS BIGINT) AS excluded, CAST(min(CASE WHEN NOT x THEN days END) AS BIGINT) AS least_days, CAST(max(CASE WHEN NOT x THEN days END) AS BIGINT) AS most_days FROM j GROUP BY 1""")
def _(spark, d):
    """A patient's end is taken to be 200 days before the last order."""
    ends = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.date_sub(F.to_date(F.max("o_orderdate")), 200).alias("ended"))
    return C.after_event(claims(spark, d), ends, ["Brand#11"])


@query("join17_claims_after_date", f"WITH {_CLAIMS}, {_ENDS} SELECT claim, patient, date, ended FROM cl JOIN en USING (patient) WHERE date > ended")
def _(spark, d):
    ends = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient")).agg(F.date_sub(F.to_date(F.max("o_orderdate")), 200).alias("ended"))
    return claims(spark, d).join(ends, "patient").where(F.col("date") > F.col("ended")).select("claim", "patient", "date", "ended")


_LOAD = f"""WITH {_EV}, v AS (SELECT provider, date, epoch(date_trunc('second', start)) / 60.0 AS s, minutes, epoch(date_trunc('second', start)) / 60.0 + minutes AS e FROM ev WHERE minutes <= 180),
i AS (SELECT *, CAST(s > coalesce(max(e) OVER (PARTITION BY provider, date ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS INTEGER) AS new FROM v),
k AS (SELECT *, sum(new) OVER (PARTITION BY provider, date ORDER BY s, e) AS island FROM i), u AS (SELECT provider, date, island, count(*) AS n, sum(minutes) AS m, max(e) - min(s) AS u FROM k GROUP BY ALL),
dd AS (SELECT provider, date, sum(n) AS visits, sum(m) AS billed, sum(u) AS covered FROM u GROUP BY ALL HAVING sum(n) >= 5), b AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY billed DESC, date) AS r FROM dd)
SELECT provider, date, CAST(visits AS BIGINT) AS visits, round(billed, 2) AS billed, round(covered, 2) AS covered, round(billed - covered, 2) AS overlap FROM b WHERE r = 1"""


@query("frd6_impossible_day", _LOAD)
def _(spark, d):
    return C.daily_load(visits(spark, d))


@query("win5_interval_union", f"SELECT round(sum(covered), 1) AS covered, round(sum(overlap), 1) AS overlap FROM ({_LOAD})")
def _(spark, d):
    return C.daily_load(visits(spark, d)).agg(F.round(F.sum("covered"), 1).alias("covered"), F.round(F.sum("overlap"), 1).alias("overlap"))


_PROFILE = f"""{_EV}, pd AS (SELECT provider, patient, date, count(*) AS n FROM ev GROUP BY ALL), p1 AS (SELECT provider, avg(n) AS claims_per_patient_day FROM pd GROUP BY 1),
ex AS (SELECT patient, count(DISTINCT service) AS k FROM ev GROUP BY 1), p2 AS (SELECT provider, avg(CAST(k <= 4 AS INTEGER)) AS exclusive_share FROM (SELECT DISTINCT provider, patient FROM ev) JOIN ex USING (patient) GROUP BY 1),
gp AS (SELECT provider, patient, service, date - lag(date) OVER (PARTITION BY provider, patient, service ORDER BY date) AS gap FROM (SELECT DISTINCT provider, patient, service, date FROM ev)),
p3 AS (SELECT provider, avg(CAST(g <= 8 AS INTEGER)) AS series_share FROM (SELECT provider, patient, service, median(gap) AS g FROM gp WHERE gap IS NOT NULL GROUP BY ALL) GROUP BY 1)"""


def _profile(spark, d):
    v = visits(spark, d)
    p1 = v.groupBy("provider", "patient", "date").agg(F.count("*").alias("n")).groupBy("provider").agg(F.avg("n").alias("claims_per_patient_day"))
    ex = v.groupBy("patient").agg(F.count_distinct("service").alias("k"))
    p2 = v.select("provider", "patient").distinct().join(ex, "patient").groupBy("provider").agg(F.avg((F.col("k") <= 4).cast("int")).alias("exclusive_share"))
    w = Window.partitionBy("provider", "patient", "service").orderBy("date")
    gaps = v.select("provider", "patient", "service", "date").distinct().withColumn("gap", F.datediff("date", F.lag("date").over(w))).where("gap IS NOT NULL")
    p3 = gaps.groupBy("provider", "patient", "service").agg(F.median("gap").alias("g")).groupBy("provider").agg(F.avg((F.col("g") <= 8).cast("int")).alias("series_share"))
    return p1.join(p2, "provider").join(p3, "provider")


@query("agg31_profile_measures", f"WITH {_PROFILE} SELECT provider, round(claims_per_patient_day, 6) AS claims_per_patient_day, round(exclusive_share, 6) AS exclusive_share, round(series_share, 6) AS series_share FROM p1 JOIN p2 USING (provider) JOIN p3 USING (provider)")
def _(spark, d):
    return _profile(spark, d).select("provider", *[F.round(c, 6).alias(c) for c in ("claims_per_patient_day", "exclusive_share", "series_share")])


@query("frd7_profile_limits", f"WITH {_PROFILE}, j AS (SELECT * FROM p1 JOIN p2 USING (provider) JOIN p3 USING (provider)) SELECT * FROM (SELECT provider, concat_ws(',', CASE WHEN claims_per_patient_day > 1.5 THEN 'claims_per_patient_day' END, CASE WHEN series_share > 0.6 THEN 'series_share' END) AS breaches FROM j) WHERE breaches <> ''")
def _(spark, d):
    return C.profile_breaches(_profile(spark, d), {"claims_per_patient_day": 1.5, "series_share": 0.6})


_NEXT = f"""{_EV}, nx AS (SELECT provider, coalesce(lead(date) OVER (PARTITION BY patient, service ORDER BY date, claim) - date = 1, false) AS hit FROM ev), own AS (SELECT provider, count(*) AS n, sum(CAST(hit AS INTEGER)) AS hits FROM nx GROUP BY 1), tot AS (SELECT sum(n) AS tn, sum(hits) AS th FROM own)"""


@query("frd8_next_day_rebills", f"WITH {_NEXT} SELECT provider, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, round(hits / n, 6) AS rate, round((th - hits) / (tn - n), 6) AS peer_rate FROM own, tot")
def _(spark, d):
    w = Window.partitionBy("patient", "service").orderBy("date", "claim")
    flags = visits(spark, d).select("provider", F.coalesce(F.datediff(F.lead("date").over(w), "date") == 1, F.lit(False)).alias("hit"))
    return C.peer_rate(flags, "provider", F.col("hit"))


@query("frd9_isolated_rebills", f"""WITH {_EV}, dd AS (SELECT DISTINCT patient, service, provider, date FROM ev), g AS (SELECT *, date - lag(date) OVER w AS before, lead(date) OVER w - date AS gap, lead(date, 2) OVER w - lead(date) OVER w AS after FROM dd WINDOW w AS (PARTITION BY patient, service, provider ORDER BY date))
SELECT provider, CAST(count(*) AS BIGINT) AS n FROM g WHERE gap = 1 AND NOT coalesce(before < 7, false) AND NOT coalesce(after < 7, false) GROUP BY 1""")
def _(spark, d):
    w = Window.partitionBy("patient", "service", "provider").orderBy("date")
    days = visits(spark, d).select("patient", "service", "provider", "date").distinct()
    g = days.withColumn("before", F.datediff("date", F.lag("date").over(w))).withColumn("gap", F.datediff(F.lead("date").over(w), "date")).withColumn("after", F.datediff(F.lead("date", 2).over(w), F.lead("date").over(w)))
    alone = ~F.coalesce(F.col("before") < 7, F.lit(False)) & ~F.coalesce(F.col("after") < 7, F.lit(False))
    return g.where((F.col("gap") == 1) & alone).groupBy("provider").agg(F.count("*").alias("n"))


@query("frd10_price_outliers", f"WITH {_CLAIMS}, m AS (SELECT provider, service, median(paid) AS median, count(*) AS n FROM cl GROUP BY ALL HAVING count(*) >= 4 AND median(paid) > 0) SELECT claim, provider, service, paid, round(median, 4) AS median FROM cl JOIN m USING (provider, service) WHERE paid >= 2 * median")
def _(spark, d):
    return C.own_median_outliers(claims(spark, d), ["provider", "service"]).withColumn("median", F.round("median", 4))


@query("frd11_split_same_day", f"""WITH {_EV}, v AS (SELECT provider, patient, date, count(*) AS n FROM ev GROUP BY ALL), own AS (SELECT provider, count(*) AS n, sum(CAST(n >= 3 AS INTEGER)) AS hits FROM v GROUP BY 1), tot AS (SELECT sum(n) AS tn, sum(hits) AS th FROM own)
SELECT provider, CAST(n AS BIGINT) AS n, CAST(hits AS BIGINT) AS hits, round(hits / n, 6) AS rate, round((th - hits) / (tn - n), 6) AS peer_rate FROM own, tot WHERE hits >= 3""")
def _(spark, d):
    v = visits(spark, d).groupBy("provider", "patient", "date").agg(F.count("*").alias("k"))
    return C.peer_rate(v, "provider", F.col("k") >= 3).where("hits >= 3")


_DECIDE = f"""{_PROFILE}, j AS (SELECT * FROM p1 JOIN p2 USING (provider) JOIN p3 USING (provider)), sc AS (SELECT provider, 1 / (1 + exp(-(claims_per_patient_day - 1.2) / 0.05)) AS p FROM j WHERE provider % 2 = 0), pf AS (SELECT provider FROM j WHERE series_share > 0.55)"""


@query("frd12_decide", f"WITH {_DECIDE} SELECT provider, round(p, 6) AS p, p >= 0.5 AS flagged, greatest(p, 1 - p) >= 0.85 AS confident, 'check' AS source FROM sc UNION ALL SELECT provider, NULL, true, false, 'unexplained' FROM pf WHERE provider NOT IN (SELECT provider FROM sc WHERE p >= 0.5)")
def _(spark, d):
    """Checks report on every second provider, the profile on all."""
    prof = _profile(spark, d)
    scored = prof.where("provider % 2 = 0").select("provider", (1 / (1 + F.exp(-(F.col("claims_per_patient_day") - 1.2) / 0.05))).alias("p"))
    return C.decide(scored, prof.where("series_share > 0.55").select("provider"))


_FOUND = f"""{_CLAIMS}, truth AS (SELECT DISTINCT provider FROM cl WHERE provider % 3 = 0), found AS (SELECT DISTINCT provider FROM cl WHERE provider % 2 = 0)"""


def _truth_found(spark, d):
    c = claims(spark, d)
    t = c.where("provider % 3 = 0").select("provider").distinct()
    return t, c.where("provider % 2 = 0").select("provider").distinct()


@query("frd13_findings_score", f"WITH {_FOUND} SELECT CAST(count(*) FILTER (truth.provider IS NOT NULL AND found.provider IS NOT NULL) AS BIGINT) AS hits, CAST(count(*) FILTER (found.provider IS NULL) AS BIGINT) AS missed, CAST(count(*) FILTER (truth.provider IS NULL) AS BIGINT) AS false_positives FROM truth FULL JOIN found ON truth.provider = found.provider")
def _(spark, d):
    t, f = _truth_found(spark, d)
    j = t.withColumn("t", F.lit(1)).join(f.withColumn("f", F.lit(1)), "provider", "full_outer")
    return j.agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("hits"), F.count_if(F.col("f").isNull()).alias("missed"), F.count_if(F.col("t").isNull()).alias("false_positives"))


@query("frd14_tool_order", """WITH p AS (SELECT user_id AS run, event_type AS tool, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), f AS (SELECT run, tool, min(pos) AS first FROM p GROUP BY ALL) SELECT tool, CAST(count(*) AS BIGINT) AS runs, median(first) AS median_first FROM f GROUP BY 1 HAVING count(*) >= 3""")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("tool"), F.row_number().over(w).alias("pos"))
    return p.groupBy("run", "tool").agg(F.min("pos").alias("first")).groupBy("tool").agg(F.count("*").alias("runs"), F.median("first").alias("median_first")).where("runs >= 3")


@query("frd15_learned_thresholds", f"WITH {_PROFILE}, j AS (SELECT p1.provider, claims_per_patient_day AS v, p1.provider % 4 = 0 AS guilty FROM p1) SELECT round(max(CASE WHEN NOT guilty THEN v END), 6) AS max_clean, round(min(CASE WHEN guilty THEN v END), 6) AS min_guilty, round(CASE WHEN min(CASE WHEN guilty THEN v END) > max(CASE WHEN NOT guilty THEN v END) THEN (min(CASE WHEN guilty THEN v END) + max(CASE WHEN NOT guilty THEN v END)) / 2 ELSE max(CASE WHEN NOT guilty THEN v END) * 1.1 END, 6) AS threshold FROM j")
def _(spark, d):
    guilty = F.col("provider") % 4 == 0
    clean, bad = F.max(F.when(~guilty, F.col("claims_per_patient_day"))), F.min(F.when(guilty, F.col("claims_per_patient_day")))
    return _profile(spark, d).agg(F.round(clean, 6).alias("max_clean"), F.round(bad, 6).alias("min_guilty"), F.round(F.when(bad > clean, (bad + clean) / 2).otherwise(clean * 1.1), 6).alias("threshold"))


@query("frd16_logistic_calibration")
def _(spark, d):
    pts = table(spark, d, "events").select((F.col("value") / 100).alias("x"), (F.col("event_type") == "purchase").cast("double").alias("y"))
    a, b = C.logistic_fit(pts, "x", "y")
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
    return pts.agg(F.lit(round(a, 6)).alias("intercept"), F.lit(round(b, 6)).alias("slope"), F.round(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))), 6).alias("log_loss"))


_COND = """pc AS (SELECT DISTINCT o_custkey AS patient, p_brand AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'), cc AS (SELECT DISTINCT o_custkey AS patient, p_brand AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A' AND l_quantity > 25)"""


def _conditions(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    pick = lambda cond: j.where(cond).select(F.col("o_custkey").alias("patient"), F.col("p_brand").alias("code")).distinct()
    return pick("l_returnflag = 'R'"), pick("l_returnflag = 'A' AND l_quantity > 25")


@query("join15_claimed_vs_recorded", f"WITH {_COND} SELECT cc.code, CASE WHEN pc.code IS NULL THEN 'unrecorded' ELSE 'agree' END AS kind, CAST(count(*) AS BIGINT) AS n FROM cc LEFT JOIN pc ON pc.patient = cc.patient AND pc.code = cc.code GROUP BY ALL")
def _(spark, d):
    pc, cc = _conditions(spark, d)
    j = cc.join(pc.withColumn("held", F.lit(1)), ["patient", "code"], "left")
    return j.groupBy("code", F.when(F.col("held").isNull(), "unrecorded").otherwise("agree").alias("kind")).agg(F.count("*").alias("n"))


@query("frd17_unrecorded_claims", f"WITH {_COND} SELECT cc.patient, cc.code FROM cc ANTI JOIN pc ON pc.patient = cc.patient AND pc.code = cc.code")
def _(spark, d):
    pc, cc = _conditions(spark, d)
    return cc.join(pc, ["patient", "code"], "left_anti").select("patient", "code")


_ONSET = """os AS (SELECT o_custkey AS patient, p_brand AS code, min(CAST(l_shipdate AS DATE)) AS onset FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _onsets(spark, d):
    return claims(spark, d).groupBy("patient", F.col("service").alias("code")).agg(F.min("date").alias("onset"))


@query("frd18_primary_condition", f"WITH {_ONSET}, r AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY list_position(['Brand#13', 'Brand#21', 'Brand#11'], code), onset) AS k FROM os WHERE code IN ('Brand#13', 'Brand#21', 'Brand#11')) SELECT patient, code, onset FROM r WHERE k = 1")
def _(spark, d):
    wanted = ["Brand#13", "Brand#21", "Brand#11"]
    w = Window.partitionBy("patient").orderBy(F.array_position(F.array(*map(F.lit, wanted)), F.col("code")), "onset")
    return _onsets(spark, d).where(F.col("code").isin(wanted)).withColumn("k", F.row_number().over(w)).where("k = 1").select("patient", "code", "onset")


@query("join16_later_conditions", f"WITH {_ONSET}, p AS (SELECT patient, min(onset) AS first FROM os WHERE code = 'Brand#13' GROUP BY 1) SELECT os.patient, CAST(count(*) AS BIGINT) AS later FROM os JOIN p USING (patient) WHERE os.onset > greatest(first, DATE '1999-01-01') GROUP BY 1")
def _(spark, d):
    o = _onsets(spark, d)
    p = o.where("code = 'Brand#13'").groupBy("patient").agg(F.min("onset").alias("first"))
    return o.join(p, "patient").where(F.col("onset") > F.greatest("first", F.lit("1999-01-01").cast("date"))).groupBy("patient").agg(F.count("*").alias("later"))


@query("frd19_repeated_calls", "SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) - count(DISTINCT event_type || props) AS BIGINT) AS repeated FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), (F.count("*") - F.count_distinct(F.concat("event_type", "props"))).alias("repeated"))


@query("frd21_missed", f"WITH {_FOUND} SELECT provider FROM truth WHERE provider NOT IN (SELECT provider FROM found)")
def _(spark, d):
    t, f = _truth_found(spark, d)
    return t.join(f, "provider", "left_anti")


@query("frd22_target_in_top", f"WITH {_CLAIMS}, s AS (SELECT provider, round(sum(paid), 2) AS total FROM cl GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total DESC, provider) AS k FROM s) SELECT provider, CAST(k AS BIGINT) AS place, k <= 10 AS accepted FROM r WHERE provider % 10 = 7")
def _(spark, d):
    s = claims(spark, d).groupBy("provider").agg(F.round(F.sum("paid"), 2).alias("total"))
    return numbered(s, [F.desc("total"), F.col("provider")], "k").where("provider % 10 = 7").select("provider", F.col("k").cast("bigint").alias("place"), (F.col("k") <= 10).alias("accepted"))


@query("frd23_net_score", f"WITH {_FOUND} SELECT CAST((SELECT count(*) FROM truth JOIN found USING (provider)) - (SELECT count(*) FROM found ANTI JOIN truth USING (provider)) AS BIGINT) AS net")
def _(spark, d):
    t, f = _truth_found(spark, d)
    j = f.join(t.withColumn("t", F.lit(1)), "provider", "left")
    return j.agg(F.sum(F.when(F.col("t").isNotNull(), 1).otherwise(-1)).alias("net"))


@query("frd20_planted_cases", f"WITH {_CLAIMS} SELECT *, CAST(NULL AS VARCHAR) AS scheme FROM cl UNION ALL SELECT -claim, patient, provider, service, date, minutes, paid, 'duplicate' FROM cl WHERE CAST('0x' || substring(md5('17:' || CAST(claim AS VARCHAR)), 1, 15) AS BIGINT) % 200 = 0")
def _(spark, d):
    """Fixture generator: claims with planted repeats and their answer key, by a seeded rule."""
    c = claims(spark, d)
    planted = c.where(X.seeded(17, "claim") % 200 == 0).select((-F.col("claim")).alias("claim"), "patient", "provider", "service", "date", "minutes", "paid", F.lit("duplicate").alias("scheme"))
    return c.withColumn("scheme", F.lit(None).cast("string")).unionByName(planted)


@query("win3_gaps", f"WITH {_EV} SELECT claim, date - lag(date) OVER w AS before, lead(date) OVER w - date AS after FROM ev WINDOW w AS (PARTITION BY patient, service ORDER BY date, claim)")
def _(spark, d):
    w = Window.partitionBy("patient", "service").orderBy("date", "claim")
    return visits(spark, d).select("claim", F.datediff("date", F.lag("date").over(w)).cast("bigint").alias("before"), F.datediff(F.lead("date").over(w), "date").cast("bigint").alias("after"))


@query("join19_adjacent_claims", f"WITH {_CLAIMS} SELECT * FROM (SELECT claim, lag(claim) OVER (PARTITION BY patient, service ORDER BY date, claim) AS previous, date - lag(date) OVER (PARTITION BY patient, service ORDER BY date, claim) AS days FROM cl) WHERE days <= 30")
def _(spark, d):
    w = Window.partitionBy("patient", "service").orderBy("date", "claim")
    return claims(spark, d).select("claim", F.lag("claim").over(w).alias("previous"), F.datediff("date", F.lag("date").over(w)).cast("bigint").alias("days")).where("days <= 30")


@query("win4_runs_of_days", f"WITH {_EV}, dd AS (SELECT DISTINCT patient, date FROM ev), i AS (SELECT *, date - CAST(row_number() OVER (PARTITION BY patient ORDER BY date) AS INTEGER) AS island FROM dd) SELECT patient, min(date) AS first, max(date) AS last, CAST(count(*) AS BIGINT) AS length FROM i GROUP BY patient, island HAVING count(*) >= 5")
def _(spark, d):
    return C.runs_of_days(visits(spark, d), ["patient"], "date", 5).select("patient", "first", "last", "length")


@query("agg25_pass_rate", "SELECT event_type, round(avg(CAST(value > 50 AS INTEGER)), 6) AS rate, round(1.96 * sqrt(avg(CAST(value > 50 AS INTEGER)) * (1 - avg(CAST(value > 50 AS INTEGER))) / count(*)), 6) AS half_width FROM events GROUP BY 1")
def _(spark, d):
    p = F.avg((F.col("value") > 50).cast("int"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(p, 6).alias("rate"), F.round(1.96 * F.sqrt(p * (1 - p) / F.count("*")), 6).alias("half_width"))


@query("agg26_cost_rollup", "SELECT user_id % 10 AS model, round(sum(value * CASE event_type WHEN 'click' THEN 1.25 WHEN 'view' THEN 0.1 ELSE 1.0 END), 4) AS cost FROM events GROUP BY 1")
def _(spark, d):
    price = spark.createDataFrame([("click", 1.25), ("view", 0.1)], "event_type string, price double")
    e = table(spark, d, "events").join(F.broadcast(price), "event_type", "left")
    return e.groupBy((F.col("user_id") % 10).alias("model")).agg(F.round(F.sum(F.col("value") * F.coalesce("price", F.lit(1.0))), 4).alias("cost"))


@query("agg27_tool_usage", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, props) AS r FROM (SELECT event_type, props, count(*) AS n FROM events GROUP BY event_type, props)), t AS (SELECT event_type, CAST(sum(n) AS BIGINT) AS calls, string_agg(CASE WHEN r <= 3 THEN props END, ' ' ORDER BY r) AS top_args FROM a GROUP BY 1),
p AS (SELECT user_id, event_type, min(pos) AS first, bool_or(value > 90) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) GROUP BY ALL),
u AS (SELECT event_type, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (evidence) AS BIGINT) AS evidence_runs, median(first) AS first_place FROM p GROUP BY 1) SELECT event_type, calls, runs, evidence_runs, CAST(first_place AS DOUBLE) AS first_place, top_args FROM t JOIN u USING (event_type)""")
def _(spark, d):
    """Of each tool its calls, the runs that use it and find something with it, where in a run it first comes, and its usual arguments."""
    e = table(spark, d, "events")
    a = e.groupBy("event_type", "props").agg(F.count("*").alias("n"))
    top = a.groupBy("event_type").agg(F.sum("n").alias("calls"))
    best = a.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "props"))).where("r <= 3")
    args = best.groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "props"))), lambda x: x.props), " ").alias("top_args"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    p = e.withColumn("pos", place).groupBy("user_id", "event_type").agg(F.min("pos").alias("first"), F.max(F.col("value") > 90).alias("evidence"))
    u = p.groupBy("event_type").agg(F.count("*").alias("runs"), F.count_if("evidence").alias("evidence_runs"), F.percentile("first", F.lit(0.5)).alias("first_place"))
    return top.join(u, "event_type").join(args, "event_type").select("event_type", "calls", "runs", "evidence_runs", "first_place", "top_args")


@query("agg28_outcome_counters", "SELECT event_type AS scheme, CAST(count(*) FILTER (value > 20) AS BIGINT) AS found, CAST(count(*) FILTER (NOT value > 20) AS BIGINT) AS missed FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("scheme")).agg(F.count_if(F.col("value") > 20).alias("found"), F.count_if(~(F.col("value") > 20)).alias("missed"))


@query("agg30_session_metrics", "SELECT user_id, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, arg_max(value, ts) AS last_value, round(median(value), 6) AS median_value FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("value", "ts").alias("last_value"), F.round(F.median("value"), 6).alias("median_value"))
