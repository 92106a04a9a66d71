"""Rule-based classifiers, guards and check workflows as column expressions and tables of rules."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_route(text: Column, signals: dict[str, dict[str, float]], least: dict[str, float], fallback: str) -> Column:
    """Struct (route, score): phrases add up per route; the first route in order that reaches its least score."""
    low = F.lower(text)
    score = {r: sum((F.when(low.contains(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in ps.items()), F.lit(0.0)) for r, ps in signals.items()}
    out = None
    for r in signals:
        c = F.struct(F.lit(r).alias("route"), score[r].alias("score"))
        out = F.when(score[r] >= least[r], c) if out is None else out.when(score[r] >= least[r], c)
    return out.otherwise(F.struct(F.lit(fallback).alias("route"), F.lit(0.0).alias("score")))


def softmax_route(text: Column, phrases: dict[str, list[str]], fallback: str) -> Column:
    """Struct (route, p): each phrase scores 1 + 0.35 per blank in it; softmax of scores up to 8, ties by name."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    score = {r: sum((F.when(low.contains(f" {p} "), F.lit(1 + 0.35 * p.count(" "))).otherwise(F.lit(0.0)) for p in ps), F.lit(0.0)) for r, ps in phrases.items()}
    total = sum((F.exp(F.least(s, F.lit(8.0))) for s in score.values()), F.lit(0.0))
    best = F.greatest(*score.values())
    name = F.coalesce(*[F.when(score[r] == best, F.lit(r)) for r in sorted(score)])
    return F.struct(F.when(best > 0, name).otherwise(F.lit(fallback)).alias("route"), F.when(best > 0, F.exp(F.least(best, F.lit(8.0))) / total).otherwise(F.lit(0.0)).alias("p"))


def access_decisions(calls: DataFrame, rules: list[dict]) -> DataFrame:
    """Calls with ``decision``: the first rule whose tool, agent and argument patterns match; ask if none does.

    Patterns are globs, or regular expressions after ``re:``; rules are a stated list.
    """

    def pattern(p: str | None) -> str:
        if not p:
            return ".*"
        return p[3:] if p.startswith("re:") else "^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$"

    hit = [F.when(F.col("tool").rlike(pattern(r.get("tool"))) & F.col("agent").rlike(pattern(r.get("agent"))) & F.coalesce(F.col("args"), F.lit("")).rlike(pattern(r.get("args"))), F.lit(r["decision"])) for r in rules]
    return calls.withColumn("decision", F.coalesce(*hit, F.lit("ask")))


def label_with_margin(scores: DataFrame, key: str, label: str, p: str, unsure: str = "unsure", least: float = 0.5, margin: float = 0.25) -> DataFrame:
    """(key, decision): the best label; none if it is unsure or below ``least``, ambiguous if the next is near."""
    w = Window.partitionBy(key).orderBy(F.desc(p), label)
    r = scores.withColumn("r", F.row_number().over(w)).where("r <= 2")
    g = r.groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col(label))).alias("l"), F.max(F.when(F.col("r") == 1, F.col(p))).alias("a"), F.max(F.when(F.col("r") == 2, F.col(p))).alias("b"))
    return g.select(key, F.when((F.col("l") == unsure) | (F.col("a") < least), "none").when(F.col("a") - F.coalesce("b", F.lit(0.0)) < margin, "ambiguous").otherwise(F.col("l")).alias("decision"))


def unmet(requirements: dict[str, Column]) -> Column:
    """Names of the requirements that don't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in requirements.items()]))


def quality_score(checks: list[Column]) -> Column:
    """Mean of the checks that apply; null ones are skipped, none at all gives null."""
    xs = F.array_compact(F.array(*[c.cast("double") for c in checks]))
    return F.when(F.size(xs) > 0, F.round(F.aggregate(xs, F.lit(0.0), lambda s, x: s + x) / F.size(xs), 4))


class Registry:
    """Named DataFrame functions with their parameters' kinds and an approval status."""

    def __init__(self):
        self.ops: dict[str, tuple[Callable[..., DataFrame], dict[str, type], str]] = {}

    def add(self, name: str, fn: Callable[..., DataFrame], params: dict[str, type] | None = None, status: str = "pending") -> None:
        if name in self.ops:
            raise ValueError(f"{name} is taken")
        self.ops[name] = (fn, params or {}, status)

    def approve(self, name: str) -> None:
        fn, params, _ = self.ops[name]
        self.ops[name] = (fn, params, "approved")

    def call(self, name: str, df: DataFrame, **params) -> DataFrame:
        fn, kinds, status = self.ops[name]
        if status != "approved":
            raise PermissionError(f"{name} is {status}")
        for k, v in params.items():
            if k not in kinds or not isinstance(v, kinds[k]):
                raise TypeError(f"{name} takes no {k}={v!r}")
        return fn(df, **params)


def validated_spec(text: str, registry: Registry) -> list[dict]:
    """The steps of a JSON workflow, each {id, op, input, params}; inputs must be earlier steps or ``source``."""
    steps, known = json.loads(text), {"source"}
    for s in steps:
        missing = {"id", "op"} - s.keys()
        if missing:
            raise ValueError(f"a step lacks {', '.join(sorted(missing))}")
        if s["op"] not in registry.ops:
            raise ValueError(f"no operation {s['op']}")
        if s.get("input", "source") not in known:
            raise ValueError(f"{s['id']} reads {s['input']}, which doesn't come before it")
        if s["id"] in known:
            raise ValueError(f"two steps are named {s['id']}")
        known.add(s["id"])
    return steps


def run_spec(steps: list[dict], source: DataFrame, registry: Registry) -> dict[str, DataFrame]:
    """The DataFrame of each step; nothing runs before one is asked for rows."""
    out = {"source": source}
    for s in steps:
        out[s["id"]] = registry.call(s["op"], out[s.get("input", "source")], **s.get("params", {}))
    return out


def audited(fn: Callable[..., DataFrame], log: list[dict]) -> Callable[..., DataFrame]:
    """The function with one log row a call: name, outcome and milliseconds."""
    import time

    def run(*args, **kwargs):
        began, outcome = time.perf_counter(), "ok"
        try:
            return fn(*args, **kwargs)
        except Exception as e:
            outcome = type(e).__name__
            raise
        finally:
            log.append({"name": fn.__name__, "outcome": outcome, "ms": round(1000 * (time.perf_counter() - began), 3)})

    return run
