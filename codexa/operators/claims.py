"""Claims analytics: peers, repeats, loads and limits per provider.

A claim is a row (claim, patient, provider, service, date, start, minutes,
paid). Dates are dates; amounts are doubles rounded where shown. Nothing here
compares claims pairwise: peers come from sorted windows, repeats from lags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.operators.graph import ensure_checkpoint_dir
from codexa.operators.ranges import running_sum

#: Hundredths of a value in one range of places.
VALUE_RANGE = 20_000


def provider_summary(claims: DataFrame, least_claims: int = 1) -> DataFrame:
    """Claims, patients, total and mean paid, and the share of the most frequent service (ties: smaller name)."""
    top = Window.partitionBy("provider").orderBy(F.desc("n"), "service")
    by = claims.groupBy("provider", "service").agg(F.count("*").alias("n"))
    first = by.withColumn("r", F.row_number().over(top)).where("r = 1").select("provider", F.col("service").alias("top_service"), "n")
    base = claims.groupBy("provider").agg(F.count("*").alias("claims"), F.count_distinct("patient").alias("patients"), F.round(F.sum("paid"), 2).alias("total"), F.round(F.avg("paid"), 2).alias("mean"))
    return base.where(F.col("claims") >= least_claims).join(first, "provider").select("provider", "claims", "patients", "total", "mean", "top_service", F.round(F.col("n") / F.col("claims"), 4).alias("top_share"))


def leave_one_out_median(claims: DataFrame, group: str, own: str, value: str) -> DataFrame:
    """(group, own, own_n, own_mean, peer_n, peer_median): the median of everybody else in the group.

    Prefix counts over the values in their order give each provider's peers without comparing claims: for a
    provider, the k-th peer value is where the count of all values less the provider's own reaches k. Only the
    provider's own values break the count, so each provider looks at its own rows and two places of the order.
    """
    mine = Window.partitionBy(group, own).orderBy(value, "claim")
    rows = claims.where(F.col(value).isNotNull()).select(group, own, value, "claim")
    size = rows.groupBy(group).agg(F.count("*").alias("n"))
    ensure_checkpoint_dir(claims)
    # places in the order of a group's values, counted in ranges of values, so that a frequent group is many tasks
    placed = rows.withColumn("_at", F.floor(F.col(value) * 100)).withColumn("_tie", F.struct(value, own, "claim"))
    placed = running_sum(placed, group, "_at", "_tie", F.lit(1), "pos", width=VALUE_RANGE)
    rows = placed.join(size, group).withColumn("i", F.row_number().over(mine)).drop("_at", "_tie").checkpoint()  # looked at four times
    # an own value at place pos, the i-th of its own, has pos - i peers before it
    own_stats = rows.groupBy(group, own).agg(F.count("*").alias("own_n"), F.avg(value).alias("own_mean"), F.max("n").alias("n")).withColumn("peer_n", F.col("n") - F.col("own_n")).where("peer_n > 0")
    # places (from 1) of the middle peers among the peers
    want = own_stats.select(group, own, F.explode(F.array_distinct(F.array(F.floor((F.col("peer_n") + 1) / 2), F.floor((F.col("peer_n") + 2) / 2)))).alias("k"))
    # the k-th peer stands at place k + (own values with fewer than k peers before them)
    marks = rows.select(group, own, (F.col("pos") - F.col("i")).alias("before"))
    place = want.join(marks, [group, own]).groupBy(group, own, "k").agg((F.col("k") + F.sum((F.col("before") < F.col("k")).cast("int"))).alias("pos"))
    at = rows.select(group, "pos", F.col(value).alias("v"))
    median = place.join(at, [group, "pos"]).groupBy(group, own).agg(F.avg("v").alias("peer_median"))
    return own_stats.join(median, [group, own]).select(group, own, "own_n", "own_mean", "peer_n", "peer_median")


def peer_cost(claims: DataFrame, least_claims: int = 3, factor: float = 1.3, top_services: int = 15) -> DataFrame:
    """(provider, service, ratio, excess): each provider's service that is dearest against its peers' median.

    Only the provider's ``top_services`` most frequent services count; excess adds up what claims above
    ``factor`` times the median cost more than it.
    """
    freq = Window.partitionBy("provider").orderBy(F.desc("own_n"), "service")
    loo = leave_one_out_median(claims, "service", "provider", "paid").withColumn("r", F.row_number().over(freq)).where((F.col("r") <= top_services) & (F.col("own_n") >= least_claims) & (F.col("peer_median") > 0))
    loo = loo.withColumn("ratio", F.col("own_mean") / F.col("peer_median"))
    dear = claims.join(loo.select("service", "provider", "peer_median"), ["service", "provider"]).where(F.col("paid") > factor * F.col("peer_median"))
    excess = dear.groupBy("service", "provider").agg(F.sum(F.col("paid") - F.col("peer_median")).alias("excess"))
    best = Window.partitionBy("provider").orderBy(F.desc(F.round("ratio", 6)), "service")
    out = loo.where("ratio > 1").join(excess, ["service", "provider"], "left").withColumn("r", F.row_number().over(best)).where("r = 1")
    return out.select("provider", "service", F.round("ratio", 4).alias("ratio"), F.round(F.coalesce("excess", F.lit(0.0)), 4).alias("excess"))


def repeats(claims: DataFrame, window: int = 1, routine_gap: int = 7) -> DataFrame:
    """(provider, exact, rebilled, routine, score) of claims repeated for the same patient, service and amount.

    Exact repeats fall on one day. A repeat within ``window`` days counts as rebilled unless another claim of the
    series lies within ``routine_gap`` days on either side, which makes it routine.
    """
    key = ["patient", "service", "paid", "provider"]
    days = claims.where("paid > 0").groupBy(*key, "date").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy("date")
    gap = F.datediff("date", F.lag("date").over(w))
    rows = days.withColumn("gap", gap).withColumn("gap_before", F.datediff(F.lag("date").over(w), F.lag("date", 2).over(w))).withColumn("gap_after", F.datediff(F.lead("date").over(w), "date"))
    near = F.col("gap").between(1, window)
    steady = (F.coalesce("gap_before", F.lit(9999)) <= routine_gap) | (F.coalesce("gap_after", F.lit(9999)) <= routine_gap)
    out = rows.groupBy("provider").agg(F.sum((F.col("n") > 1).cast("int")).cast("bigint").alias("exact"), F.sum(F.coalesce((near & ~steady).cast("int"), F.lit(0))).cast("bigint").alias("rebilled"), F.sum(F.coalesce((near & steady).cast("int"), F.lit(0))).cast("bigint").alias("routine"))
    return out.withColumn("score", F.col("exact") + 0.5 * F.col("rebilled"))


def after_event(claims: DataFrame, ends: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """(provider, n, excluded, least_days, most_days): claims dated after the patient's end (patient, ended)."""
    late = claims.join(ends, "patient").where(F.col("date") > F.col("ended")).withColumn("days", F.datediff("date", "ended")).withColumn("out", F.col("service").isin(list(excluded)) if excluded else F.lit(False))
    return late.groupBy("provider").agg(
        F.sum((~F.col("out")).cast("int")).cast("bigint").alias("n"), F.sum(F.col("out").cast("int")).cast("bigint").alias("excluded"),
        F.min(F.when(~F.col("out"), F.col("days"))).cast("bigint").alias("least_days"), F.max(F.when(~F.col("out"), F.col("days"))).cast("bigint").alias("most_days"),
    )


def daily_load(visits: DataFrame, most_minutes: int = 180, least_visits: int = 5) -> DataFrame:
    """(provider, date, visits, billed, covered, overlap): each provider's busiest day; ties go to the earlier day.

    Covered minutes are those of the union of the day's intervals [start, start + minutes).
    """
    v = visits.where(F.col("minutes") <= most_minutes).select("provider", "date", (F.unix_timestamp("start") / 60).cast("double").alias("s"), "minutes").withColumn("e", F.col("s") + F.col("minutes"))
    before = Window.partitionBy("provider", "date").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("provider", "date").orderBy("s", "e")
    v = v.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(before), F.lit(-1.0))).cast("int")).withColumn("island", F.sum("new").over(upto))
    union = v.groupBy("provider", "date", "island").agg(F.count("*").alias("n"), F.sum("minutes").alias("m"), (F.max("e") - F.min("s")).alias("u"))
    day = union.groupBy("provider", "date").agg(F.sum("n").alias("visits"), F.sum("m").alias("billed"), F.sum("u").alias("covered")).where(F.col("visits") >= least_visits)
    busiest = Window.partitionBy("provider").orderBy(F.desc("billed"), "date")
    return day.withColumn("r", F.row_number().over(busiest)).where("r = 1").select("provider", "date", "visits", F.round("billed", 2).alias("billed"), F.round("covered", 2).alias("covered"), F.round(F.col("billed") - F.col("covered"), 2).alias("overlap"))


def profile_breaches(profile: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(provider, breaches): names of the measures beyond their limit, joined by commas; providers without any are left out."""
    over = F.array_compact(F.array(*[F.when(F.col(k) > v, F.lit(k)) for k, v in limits.items()]))
    return profile.withColumn("over", over).where(F.size("over") > 0).select("provider", F.array_join("over", ",").alias("breaches"))


def peer_rate(flags: DataFrame, key: str, hit: Column) -> DataFrame:
    """(key, n, hits, rate, peer_rate): a key's share of hits, and that of all others together."""
    own = flags.groupBy(key).agg(F.count("*").alias("n"), F.sum(hit.cast("int")).cast("bigint").alias("hits"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("hits").alias("th"))
    j = own.crossJoin(F.broadcast(total))  # one row
    return j.select(key, "n", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("rate"), F.round((F.col("th") - F.col("hits")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), 6).alias("peer_rate"))


def own_median_outliers(claims: DataFrame, key: list[str], least: int = 4, factor: float = 2.0) -> DataFrame:
    """Claims that cost at least ``factor`` times the median of their group of ``least`` claims or more."""
    med = claims.groupBy(*key).agg(F.median("paid").alias("median"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("median") > 0))
    return claims.join(med, key).where(F.col("paid") >= factor * F.col("median")).select("claim", *key, "paid", "median")


def runs_of_days(days: DataFrame, key: list[str], date: str, least: int) -> DataFrame:
    """(key, first, last, length): runs of consecutive days of at least ``least``."""
    d = days.select(*key, F.col(date).cast("date").alias("d")).distinct()
    w = Window.partitionBy(*key).orderBy("d")
    d = d.withColumn("island", F.date_sub("d", F.row_number().over(w)))
    return d.groupBy(*key, "island").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def logistic_fit(points: DataFrame, x: str, y: str, ridge: float = 1e-3, rounds: int = 25) -> tuple[float, float]:
    """(intercept, slope) of a ridge logistic fit in one dimension, by Newton steps over aggregated sums."""
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col(x))))
        w = p * (1 - p)
        r = points.agg(F.sum(F.col(y) - p), F.sum((F.col(y) - p) * F.col(x)), F.sum(w), F.sum(w * F.col(x)), F.sum(w * F.col(x) * F.col(x))).first()
        if r[0] is None:
            return 0.0, 0.0
        g0, g1, h00, h01, h11 = r[0] - ridge * a, r[1] - ridge * b, r[2] + ridge, r[3], r[4] + ridge
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def decide(reported: DataFrame, profile: DataFrame, threshold: float = 0.5, sure: float = 0.85) -> DataFrame:
    """(provider, p, flagged, confident, source): scored providers, and flagged profiles that no check explains."""
    conf = F.greatest("p", 1 - F.col("p"))
    a = reported.select("provider", F.round("p", 6).alias("p"), (F.col("p") >= threshold).alias("flagged"), (conf >= sure).alias("confident"), F.lit("check").alias("source"))
    rest = profile.join(reported.where(F.col("p") >= threshold), "provider", "left_anti").select("provider", F.lit(None).cast("double").alias("p"), F.lit(True).alias("flagged"), F.lit(False).alias("confident"), F.lit("unexplained").alias("source"))
    return a.unionByName(rest)
