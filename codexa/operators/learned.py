"""Tools, classifiers and embedders that come from outside: checked, then run on groups or batches."""

from __future__ import annotations

import ast
import hashlib
import json
import re
import subprocess
import sys
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a tool may call and import; names with two leading underscores and any other statement at the top are refused.
CALLS = frozenset("abs all any bool dict enumerate filter float int isinstance len list map max min range round set sorted str sum tuple zip".split())
MODULES = frozenset("math statistics datetime collections itertools".split())
CPU_SECONDS, WALL_SECONDS = 15, 20


def problems(code: str) -> list[str]:
    """Why a tool is refused: it must be one documented function whose further parameters have plain defaults, and call only what is allowed."""
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"syntax: {e.msg}"]
    out, functions = [], [x for x in tree.body if isinstance(x, ast.FunctionDef)]
    if len(functions) != 1 or any(not isinstance(x, (ast.FunctionDef, ast.Import, ast.ImportFrom)) for x in tree.body):
        return ["exactly one function is wanted"]
    f = functions[0]
    args = f.args.args + f.args.kwonlyargs
    defaults = [*f.args.defaults, *[x for x in f.args.kw_defaults if x is not None]]
    if not ast.get_docstring(f):
        out.append("no docstring")
    if not args or len(defaults) < len(args) - 1 or f.args.vararg or f.args.kwarg:
        out.append("parameters after the first need defaults")
    if any(not isinstance(x, ast.Constant) or not isinstance(x.value, (int, float, str, bool)) for x in defaults):
        out.append("defaults must be plain")
    own = {f.name} | {x.name for x in ast.walk(f) if isinstance(x, ast.FunctionDef)}
    for x in ast.walk(tree):
        names = [a.name.split(".")[0] for a in x.names] if isinstance(x, ast.Import) else [(x.module or "").split(".")[0]] if isinstance(x, ast.ImportFrom) else []
        out += [f"import of {n}" for n in names if n not in MODULES]
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id not in CALLS | own:
            out.append(f"call of {x.func.id}")
        word = x.attr if isinstance(x, ast.Attribute) else x.id if isinstance(x, ast.Name) else ""
        if word.startswith("__"):
            out.append(f"name {word}")
        if isinstance(x, (ast.Global, ast.Nonlocal, ast.ClassDef, ast.AsyncFunctionDef, ast.With, ast.Await)):
            out.append(type(x).__name__.lower())
    return list(dict.fromkeys(out))


_CHILD = """
import json, resource, sys
resource.setrlimit(resource.RLIMIT_CPU, ({cpu}, {cpu}))
job = json.load(sys.stdin)
space = {{}}
exec(compile(job["code"], "tool", "exec"), space)
tool = space[job["name"]]
json.dump([tool(rows) for rows in job["groups"]], sys.stdout, default=str)
"""


def run_apart(code: str, groups: list, wall: float = WALL_SECONDS, cpu: int = CPU_SECONDS) -> list:
    """A tool's results for groups of rows, from a child interpreter with bounded time; no border against malice."""
    wrong = problems(code)
    if wrong:
        raise ValueError("; ".join(wrong))
    name = next(x.name for x in ast.parse(code).body if isinstance(x, ast.FunctionDef))
    job = json.dumps({"code": code, "name": name, "groups": groups}, default=str)
    p = subprocess.run([sys.executable, "-I", "-c", _CHILD.format(cpu=cpu)], input=job, capture_output=True, text=True, timeout=wall)
    if p.returncode:
        raise RuntimeError((p.stderr.strip().splitlines() or ["no message"])[-1])
    return json.loads(p.stdout)


def applied(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, score): the tool's number for each key's rows; the tool is checked before anything runs."""
    wrong = problems(code)
    if wrong:
        raise ValueError("; ".join(wrong))
    name = next(x.name for x in ast.parse(code).body if isinstance(x, ast.FunctionDef))

    def one(b: pd.DataFrame) -> pd.DataFrame:
        space: dict = {}
        exec(compile(code, "tool", "exec"), space)  # noqa: S102 - checked above
        value = space[name](b.drop(columns=[key]).to_dict("records"))
        return pd.DataFrame({key: b[key].iloc[:1].to_numpy(), "score": [float(value)]})

    return rows.groupBy(key).applyInPandas(one, f"{key} {dict(rows.dtypes)[key]}, score double")


class Classifier(Protocol):
    """Gives the probability of a yes for each row, as a column."""

    def ask(self) -> Column: ...


class Rules:
    """A classifier of ordered rules: the first that holds gives the probability."""

    def __init__(self, rules: list[tuple[Column, float]], otherwise: float):
        self.rules, self.otherwise = rules, otherwise

    def ask(self) -> Column:
        out = F.when(self.rules[0][0], self.rules[0][1])
        for cond, p in self.rules[1:]:
            out = out.when(cond, p)
        return out.otherwise(self.otherwise)


def asked(rows: DataFrame, key: str, classifier: Classifier, fallback: Classifier | None = None, sure: float = 0.0) -> DataFrame:
    """(key, probability): the classifier's, or the fallback's where the first is null or nearer to a half than ``sure``."""
    p = classifier.ask()
    if fallback is not None:
        p = F.when(F.abs(p - 0.5) >= sure, p).otherwise(fallback.ask())
    return rows.select(key, p.cast("double").alias("probability"))


class HashEmbedder:
    """Vectors of hashed words, of length one: stands in for a model where none is at hand, and in tests."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embedded(rows: DataFrame, text: str, embed, out: str = "vector") -> DataFrame:
    """Rows with the vector that ``embed(texts)`` gives, a batch at a time; null texts have none."""
    columns = rows.columns

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = embed([t or "" for t in b[text]])
            b[out] = pd.Series([None if t is None else x.tolist() for t, x in zip(b[text], v)], index=b.index, dtype=object)
            yield b[[*columns, out]]

    return rows.mapInPandas(go, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` array<float>")
