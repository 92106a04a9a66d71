"""Problem 4: pieces under a size limit, cut at natural boundaries.

Content-defined chunking: a rolling hash over a window of characters marks
landmarks; of those between a least and a greatest size the one with the
greatest hash is taken, and snaps to the nearest boundary of the coarsest kind
in reach. Windows that overlap mostly share that landmark, so cuts fall back
into step soon after an edit. A row is cut with the coarsest kind
of boundary that can do it: where none of that kind is in reach, one below the
least size is taken, or the overlap is shortened, before a finer kind. Cuts hang on nearby content only, so
an edit alters the pieces next to it. Pieces of a row overlap by about
``overlap`` characters, taken from before the cut and begun at a word.

Defined results: null content gives one piece of null; content within the
limit stays one piece, unchanged; blanks at a cut belong to neither piece.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.sources.tables import spread

MOST, LEAST, OVERLAP = 1400, 500, 100
#: Rows of one document are numbered in ranges of this many chunk indexes, so that a hot document is no single task.
INDEX_RANGE = 512
LEVELS = ("paragraph", "sentence", "word", "forced")

# Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    "mr mrs ms dr prof st jr sr no nos vs etc approx pct dept est fig figs sec ch vol ed eds eg ie cf al inc ltd co corp "
    "bldg ave blvd rd apt ste tel ext min max avg jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun "
    "e.g i.e a.m p.m u.s u.k ph.d m.d d.d.s d.m.d r.n art par para app pp p bzw z.b usw nr"
).split()
_ABBREVIATIONS = frozenset(ABBREVIATIONS)
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(\s+)|(?<=[。！？])(?=\S)")
_LAST_WORD = re.compile(r"[^\s(\[\"'“‘]*$")
_SPACE = re.compile(r"\s+")


def _ends_sentence(text: str, m: re.Match) -> bool:
    run = m.group()
    if not run or run[0] != "." or run[1:2] == ".":
        return True
    word = _LAST_WORD.search(text, max(0, m.start() - 40), m.start()).group().lower()
    if word in _ABBREVIATIONS or len(word) == 1 and word.isalpha():
        return False
    after = text[m.end() : m.end() + 1]
    return not (re.fullmatch(r"(?:[a-z]\.)+[a-z]", word) or re.fullmatch(r"\d+", word) and (m.start() - len(word) == 0 or text[m.start() - len(word) - 1] == "\n") and after)


def boundaries(text: str) -> dict[str, list[tuple[int, int]]]:
    """For each kind the (end of the left part, begin of the right part) of every boundary; coarser ones are among the finer."""
    par = [m.span() for m in _PARAGRAPH.finditer(text)]
    sen = [(m.start(1), m.end(1)) if m.group(1) else (m.start(), m.end()) for m in _END.finditer(text) if _ends_sentence(text, m)]
    word = [m.span() for m in _SPACE.finditer(text)]
    return {"paragraph": par, "sentence": sorted({*par, *sen}), "word": word}


def coarsest_cut(text: str, most: int = MOST) -> str:
    """The coarsest kind of boundary whose stretches are all at most ``most`` characters."""
    text = text.strip()
    for level, cuts in boundaries(text).items():
        at = longest = 0
        for end, begin in cuts:
            longest, at = max(longest, end - at), max(at, begin)
        if max(longest, len(text) - at) <= most:
            return level
    return "forced"


def _landmarks(text: str, window: int = 16, bits: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose rolling hash over the last ``window`` characters begins with ``bits`` zero bits, and those hashes."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, base = np.zeros(len(codes) - window + 1, np.uint64), np.uint64(0x100000001B3)
    for j in range(window):  # polynomial hash of all windows at once, modulo 2**64
        h = h * base + codes[j : len(codes) - window + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    at = np.flatnonzero(h >> np.uint64(64 - bits) == 0)
    return at + window, h[at]


def _cut(text: str, cuts: dict, ends: dict, marks: tuple[np.ndarray, np.ndarray], level: int, most: int, least: int, overlap: int) -> list[tuple[int, int]] | None:
    """(begin, end) of each piece, cut at boundaries of the kind LEVELS[level] or coarser; None if those won't do."""
    pieces, begin, core, last = [], 0, 0, len(text)
    words = [c[1] for c in cuts["word"]]

    def fitting(end: int) -> int:
        """The piece's begin, moved up to a word where the overlap would make the piece too long."""
        if end - begin <= most:
            return begin
        w = bisect_left(words, end - most)
        return min(core, words[w]) if w < len(words) else core

    own = LEVELS[min(level, 2)]
    while last - begin > most:
        # the piece holds the overlap from begin to core, then new text
        lo, hi = max(core + 1, begin + least), begin + most
        first, end = np.searchsorted(marks[0], (lo, hi + 1))
        target = int(marks[0][first + marks[1][first:end].argmax()]) if first < end else hi
        at = None
        for kind in LEVELS[: min(level, 2) + 1]:
            e = ends[kind]
            i, j = bisect_left(e, lo), bisect_right(e, hi)
            if i < j:
                k = min(range(i, j), key=lambda x: (abs(e[x] - target), -e[x]))
                at = cuts[kind][k]
                break
        if at is None:
            e = ends[own]
            i, j = bisect_left(e, lo), bisect_right(e, core + most)
            if i and e[i - 1] > core:
                at = cuts[own][i - 1]
            elif last - core <= most:
                break
            elif i < j:
                at = cuts[own][i]
            elif own == LEVELS[level]:
                return None
            else:
                at = hi, hi
        end, nxt = at
        pieces.append((fitting(end), end))
        core = nxt
        begin = max(begin + 1, end - overlap)
        w = bisect_left(ends["word"], begin)
        if begin > 0 and not text[begin - 1].isspace() and w < len(cuts["word"]) and cuts["word"][w][1] < end:
            begin = cuts["word"][w][1]
        if core - begin >= least:  # a long blank is no overlap
            begin = core
    pieces.append((fitting(last), last))
    return pieces


def cut_text(text: str | None, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> tuple[str | None, list[tuple[int, int]]]:
    """The coarsest kind of boundary that the text can be cut at, and (begin, end) of each piece, none longer than ``most``."""
    if text is None or len(text) <= most:
        return None, [(0, len(text or ""))]
    body = text.strip()
    lead = len(text) - len(text.lstrip())
    if not body:
        return LEVELS[0], [(0, 0)]
    cuts = boundaries(body)
    ends = {k: [c[0] for c in v] for k, v in cuts.items()}
    marks = _landmarks(body)
    for level, kind in enumerate(LEVELS):
        spans = _cut(body, cuts, ends, marks, level, most, least, overlap)
        if spans is not None:
            break
    spans = [(b + lead, e + lead) for b, e in spans]
    return kind, [(max(0, spans[0][1] - most), spans[0][1]), *spans[1:]]


def split_text(text: str | None, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of each piece, none longer than ``most``."""
    return cut_text(text, most, least, overlap)[1]


def _pieces(rows: DataFrame, most: int, least: int, overlap: int) -> DataFrame:
    """(id, document_id, old_index, page_number, piece, content, cut) of rows longer than ``most``; ``cut`` is the kind of boundary the row was cut at."""
    schema = "id bigint, document_id string, old_index int, page_number int, piece int, content string, cut string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = [cut_text(c, most, least, overlap) for c in b.content]
            rows = [
                (i, d, x, p, n, c[s:e], kind)
                for i, d, x, p, c, (kind, spans) in zip(b.id, b.document_id, b.chunk_index, b.page_number, b.content, split)
                for n, (s, e) in enumerate(spans)
            ]
            out = frame(rows, ["id", "document_id", "old_index", "page_number", "piece", "content", "cut"])
            yield out.astype({"id": "Int64", "old_index": "Int64", "page_number": "Int64", "piece": "int32"})

    return rows.where(F.length("content") > most).mapInPandas(run, schema)


def split_oversized(chunks: DataFrame, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """(id, document_id, chunk_index, piece, page_number, content): all rows, the long ones in pieces.

    ``chunk_index`` is counted anew from 0 within the document, in the order of the old index, id and piece.
    """
    cols = [F.col(c) for c in ("id", "document_id", "chunk_index", "page_number", "content")]
    src = chunks.select(*cols)
    long = F.coalesce(F.length("content") > most, F.lit(False))
    pieces = _pieces(src, most, least, overlap).drop("cut")
    rest = src.where(~long).select("id", "document_id", F.col("chunk_index").alias("old_index"), "page_number", F.lit(0).alias("piece"), "content")
    rows = rest.unionByName(pieces).withColumn("part", F.floor(F.coalesce("old_index", F.lit(-1)) / INDEX_RANGE).cast("int"))
    # numbering in two steps: the ranges' sizes are added up per document, then rows are counted within a range
    sizes = src.select("document_id", F.floor(F.coalesce("chunk_index", F.lit(-1)) / INDEX_RANGE).cast("int").alias("part"))
    extra = pieces.where("piece > 0").select("document_id", F.floor(F.coalesce("old_index", F.lit(-1)) / INDEX_RANGE).cast("int").alias("part"))
    sizes = sizes.unionAll(extra).groupBy("document_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("document_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("document_id").alias("d"), F.col("part").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("document_id", "part").orderBy(F.col("old_index").asc_nulls_first(), "id", "piece")
    numbered = rows.withColumn("r", F.row_number().over(within) - 1)
    out = numbered.join(sizes, F.col("document_id").eqNullSafe(F.col("d")) & (F.col("part") == F.col("q")))
    return out.select("id", "document_id", (F.col("base") + F.col("r")).cast("int").alias("chunk_index"), "piece", "page_number", "content")


def found_cuts(chunks: DataFrame, most: int = MOST, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """(id, cut) of every row longer than ``most`` characters: the kind of boundary that its pieces are cut at."""
    rows = chunks.where(F.col("id").isNotNull()).select("id", "document_id", "chunk_index", "page_number", "content")
    return _pieces(rows, most, least, overlap).select("id", "cut").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_cuts(spread(spark.read.parquet(f"{sf_dir}/rag_chunks.parquet")))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(spread(spark.read.parquet(f"{sf_dir}/rag_chunks.parquet")))
