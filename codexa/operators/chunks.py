"""Cutting texts into chunks, and reshaping extracted tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.functions.text import let


def word_windows(words: Column, size: int = 350, overlap: int = 50) -> Column:
    """Windows of ``size`` words, each beginning ``size - overlap`` after the last; a window begins at every step below the end."""
    step = size - overlap
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))


def windows(rows: DataFrame, key: str, text: str, size: int = 350, overlap: int = 50) -> DataFrame:
    """(key, piece, window): the windows of each text as rows, without a shuffle; the words are cut once, before windows are taken."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " "), lambda w: w != "")
    return rows.where(F.col(text).isNotNull()).select(key, F.posexplode(let(words, lambda w: word_windows(w, size, overlap))).alias("piece", "window"))


def packed_paragraphs(rows: DataFrame, key: str, text: str, most: int = 1400) -> DataFrame:
    """(key, piece, content): paragraphs packed greedily up to ``most`` characters, longer ones cut hard.

    Greedy packing depends on what was packed before, so it runs per text in Python batches.
    """

    def pack(t: str) -> list[str]:
        out: list[str] = []
        for p in (x.strip() for x in t.split("\n\n")):
            for part in [p[i : i + most] for i in range(0, len(p), most)]:
                if out and len(out[-1]) + 2 + len(part) <= most:
                    out[-1] += "\n\n" + part
                elif part:
                    out.append(part)
        return out

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield frame(((k, n, p) for k, t in zip(b[key], b[text]) for n, p in enumerate(pack(t))), [key, "piece", "content"])

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(go, f"{key} {kind}, piece int, content string")


def recursive_pieces(rows: DataFrame, key: str, text: str, most: int = 800, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """(key, piece, content): cut at the coarsest separator that serves, with a tenth of overlap."""

    def cut(t: str, seps: tuple[str, ...]) -> list[str]:
        if len(t) <= most:
            return [t] if t.strip() else []
        if not seps:
            return [t[i : i + most] for i in range(0, len(t), most)]
        out: list[str] = []
        for part in t.split(seps[0]):
            if out and len(out[-1]) + len(seps[0]) + len(part) <= most:
                out[-1] += seps[0] + part
            else:
                out += cut(part, seps[1:]) or []
        return out

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows_ = []
            for k, t in zip(b[key], b[text]):
                pieces = list(dict.fromkeys(cut(t, separators)))
                rows_ += [(k, n, (pieces[n - 1][-most // 10 :] + " " if n else "") + p) for n, p in enumerate(pieces)]
            yield frame(rows_, [key, "piece", "content"])

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(go, f"{key} {kind}, piece int, content string")


def table_pieces(rows: DataFrame, key: str, text: str, most: int = 4000) -> DataFrame:
    """(key, part, parts, content): a table's lines in parts up to a size, each with the header line again."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                head, *body = t.split("\n")
                parts: list[list[str]] = [[]]
                for line in body:
                    if parts[-1] and len(head) + sum(len(x) + 1 for x in parts[-1]) + len(line) + 1 > most:
                        parts.append([])
                    parts[-1].append(line)
                out += [(k, i + 1, len(parts), "\n".join([head, *p])) for i, p in enumerate(parts)]
            yield frame(out, [key, "part", "parts", "content"])

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(text).isNotNull()).select(key, text).mapInPandas(go, f"{key} {kind}, part int, parts int, content string")


def is_default_header(headers: Column) -> Column:
    """Whether headers are only 0..n-1 or 1..n, as extractors number them."""
    plain = F.transform(headers, lambda h: F.regexp_replace(h, "^Unnamed: ", "").try_cast("int"))
    n = F.size(headers)
    return (plain == F.sequence(F.lit(0), n - 1)) | (plain == F.sequence(F.lit(1), n))


def promoted(headers: Column, rows: Column) -> Column:
    """Struct (headers, rows): a table whose header is numbered gets its first row as header if that is filled and distinct."""
    first = F.try_element_at(rows, F.lit(1))
    fit = is_default_header(headers) & (F.size(rows) > 1) & ~F.exists(first, lambda x: x.isNull() | (F.trim(x) == "")) & (F.size(F.array_distinct(first)) == F.size(first))
    fit = F.coalesce(fit, F.lit(False))
    return F.struct(F.when(fit, first).otherwise(headers).alias("headers"), F.when(fit, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(1)))).otherwise(rows).alias("rows"))


def normal_table(headers: Column, rows: Column) -> Column:
    """Struct (headers, rows): all rows as wide as the widest, blank headers named by their place."""
    width = F.greatest(F.size(headers), F.array_max(F.transform(rows, F.size)))
    pad = lambda a: F.concat(a, F.array_repeat(F.lit(""), (width - F.size(a)).cast("int")))
    named = F.transform(pad(headers), lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(h))
    return F.struct(named.alias("headers"), F.transform(rows, pad).alias("rows"))


def merged_peers(rows: DataFrame, key: str, groups: list[str], text: str, budget: int = 256) -> DataFrame:
    """(groups, piece, chunks, tokens, content): neighbours of one group joined while they stay within a budget of tokens.

    Rows go in the order of ``key``; a row above the budget is a piece of its own. Greedy joining hangs on what came
    before, so each group is folded by itself; groups are sections of one document. Null texts are left out.
    """
    kinds = dict(rows.dtypes)

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for t in b.sort_values(key)[text]:
            n = -(-len(t) // 4)
            if out and out[-1][1] + n <= budget:
                out[-1][0].append(t)
                out[-1][1] += n
            else:
                out.append([[t], n])
        names = [b[g].iloc[0] for g in groups]
        return frame([(*names, i, len(x), n, "\n\n".join(x)) for i, (x, n) in enumerate(out)], [*groups, "piece", "chunks", "tokens", "content"])

    schema = ", ".join(f"{g} {kinds[g]}" for g in groups) + ", piece int, chunks int, tokens int, content string"
    return rows.where(F.col(text).isNotNull()).select(key, *groups, text).groupBy(*groups).applyInPandas(fold, schema)
