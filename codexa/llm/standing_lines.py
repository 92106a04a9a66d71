"""Problem 1: lines that the documents of one family repeat.

1. Content-defined chunks: each line's template is its words, in which figures,
   dates, names and the document's title are blanks; a rolling hash over two
   words sets the borders. Distinct documents are counted per family and chunk.
2. A line whose chunks are all repeated excessively is a candidate; the
   templates of candidates are counted per family. A chunk stands in every
   document that its template stands in, so this choice loses no line.
3. Exact check: each line is held against its family's templates, whatever
   fills their blanks, and distinct documents are counted per template again.
   Lines of templates at the threshold are standing lines.

What the families need, their repeated chunks and their templates are tables,
joined as such. Where they are counted to be at most ``bound`` rows, chunks and
templates are sent to the tasks instead; where they are more, lines meet the
chunks in a join, and the templates meet the family's texts in groups of a
bounded number of documents. The rows are the same either way.

Defined results: chunks delivered twice count once; documents without a family
have no standing lines; null texts have no lines; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.operators.graph import ensure_checkpoint_dir
from codexa.sources.tables import spread

LEAST_DOCS, SHARE, LEAST_LETTERS = 5, 0.05, 12
#: Templates are searched for from this part of the threshold on: where a title isn't known its lines have no template of their own.
EARLY = 0.25
#: Up to so many rows, repeated chunks and templates are sent to the tasks; more are joined.
BOUND = 200_000
#: Texts of one family that are held against its templates in one task, where templates are joined.
GROUP_TEXTS = 4096

# Fixed values.
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()
_MONTHS = frozenset(MONTHS)
_WORD = re.compile(r"[^\W_]+")
_ROW = re.compile(r"\t|\||_{4,}|\.{4,}|(?:\. ){4,}|\[ ?\]|[☐□]|\( {3,}\)|\s{3,}\S.*\s{3,}")
_ROWISH = re.compile(r"[\t|;_\[(☐□]|\.\.\.|\. \.|\s{3}")
_SEP = "#"
#: Of a row parted by semicolons, no cell has more words than this; prose has longer stretches.
CELL_WORDS = 6


def families(stats: DataFrame) -> DataFrame:
    """(document_id, family): the family of each document's latest run; ties go to the greater run and family."""
    rows = stats.where("document_id is not null and family is not null")
    latest = F.max_by("family", F.struct("created_at", "run_id", "family"))
    return rows.groupBy("document_id").agg(latest.alias("family")).where("family is not null")


def _texts(records: DataFrame, stats: DataFrame, titles: DataFrame | None) -> DataFrame:
    docs = families(stats)
    if titles is not None:
        one = titles.where("document is not null").groupBy("document").agg(F.max("title").alias("title"))
        docs = docs.join(one, docs.document_id == one.document, "left").select("document_id", "family", "title")
    else:
        docs = docs.withColumn("title", F.lit(None).cast("string"))
    rows = records.where("chunk_id is not null and text is not null").select("chunk_id", "document_id", "content_type", "section", "text")
    return rows.join(docs, "document_id")


def _title_pattern(title: str | None) -> re.Pattern | None:
    words = _WORD.findall(title or "")
    return re.compile(r"[\W_]+".join(map(re.escape, words)), re.I) if len(words) > 1 else None


class Stream:
    """Content-defined chunks of a batch of templates."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def chunks(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(line number, hash) of each chunk; every line has at least one, and equal lines have equal ones."""
        cache = self.cache
        if len(cache) > 500_000:
            cache.clear()
        hashes, owner = [], []
        for line in lines:
            for w in line.split(" "):
                h = cache.get(w)
                if h is None:
                    h = cache[w] = xxhash.xxh3_64_intdigest(w)
                hashes.append(h)
            owner.append(len(hashes))
        h = np.array(hashes, np.uint64)
        if not len(h):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.zeros(len(h), bool)
        start[[0, *owner[:-1]]] = True
        roll = h * np.uint64(0x9E3779B97F4A7C15)
        roll[1:] += np.where(start[1:], np.uint64(0), h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F))
        roll ^= roll >> np.uint64(33)
        line_no = np.cumsum(start) - 1
        start[1:] |= (roll[:-1] & np.uint64(7)) == 0  # a chunk ends with such a word
        begin = np.flatnonzero(start)
        place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        mixed = (h ^ (h >> np.uint64(30))) * (np.uint64(0xBF58476D1CE4E5B9) + np.uint64(2) * (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB))
        mixed ^= mixed >> np.uint64(27)
        return line_no[begin], np.add.reduceat(mixed, begin).view(np.int64)


def _is_row(line: str) -> bool:
    """Whether separators make up the line's shape, as in rows of tables and forms."""
    if not _ROWISH.search(line):
        return False
    return bool(_ROW.search(line)) or line.count(";") > 1 and all(len(c.split()) <= CELL_WORDS for c in line.split(";"))


def _templates_of(b: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """(row numbers, templates) of the lines of a batch that can stand."""
    rows, out = [], []
    for k, (text, blanked, section) in enumerate(zip(b.text, _blank_titles(b), b.section)):
        heading = [w.lower() for w in _WORD.findall(section or "")]
        plain, lines = text.split("\n"), blanked.split("\n")
        same = len(plain) == len(lines)
        for i, line in enumerate(lines):
            words = _WORD.findall(line)
            x = template(words)
            if x and not (same and _is_row(plain[i])) and not (len(words) == len(heading) and [w.lower() for w in words] == heading):
                rows.append(k)
                out.append(x)
    return np.array(rows, np.int64), out


def needs(texts: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(family, need): how many of a family's documents must hold a line that stands."""
    docs = texts.groupBy("family").agg(F.count_distinct("document_id").alias("d"))
    return docs.select("family", F.greatest(F.lit(float(least_docs)), share * F.col("d")).alias("need"))


def _reaching(counts: DataFrame, need: DataFrame, part: float = 1.0) -> DataFrame:
    """Rows (family, .., n) whose count reaches that part of what the family needs, 2 at least."""
    return counts.join(need, "family").where(F.col("n") >= F.greatest(F.lit(2.0), part * F.col("need"))).drop("need")


def repeated_chunks(texts: DataFrame, need: DataFrame) -> DataFrame:
    """(family, h): the chunks that enough of the family's documents hold."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = Stream()
        for b in batches:
            rows, lines = _templates_of(b)
            who, h = stream.chunks(lines)
            out = pd.DataFrame({"family": b.family.to_numpy()[rows[who]], "doc": b.doc.to_numpy()[rows[who]], "h": h})
            yield out.drop_duplicates()

    rows = texts.select("family", F.xxhash64("document_id").alias("doc"), "title", "section", "text").mapInPandas(go, "family string, doc bigint, h bigint")
    return _reaching(rows.groupBy("family", "h").agg(F.count_distinct("doc").alias("n")), need, EARLY).select("family", "h")


def candidate_templates(texts: DataFrame, often: DataFrame, need: DataFrame, bound: int) -> DataFrame:
    """(family, template) of lines whose chunks are all repeated, in enough documents."""
    few = often.count() <= bound
    held: dict[str, list[int]] = defaultdict(list)
    for r in often.toLocalIterator() if few else ():
        held[r.family].append(r.h)
    sent = texts.sparkSession.sparkContext.broadcast({f: np.sort(np.array(v, np.int64)) for f, v in held.items()} if few else None)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, known = Stream(), sent.value
        for b in batches:
            at, lines = _templates_of(b)
            who, h = stream.chunks(lines)
            fam = b.family.to_numpy()
            if known is not None:
                keep = np.ones(len(lines), bool)
                for f in set(b.family):
                    mine = fam[at[who]] == f
                    keep[who[mine][~np.isin(h[mine], known.get(f, ()))]] = False
                rows = {(b.family.iat[at[i]], b.document_id.iat[at[i]], lines[i], None) for i in np.flatnonzero(keep)}
            else:
                edge = np.searchsorted(who, np.arange(len(lines) + 1))
                rows = {(b.family.iat[at[i]], b.document_id.iat[at[i]], x, tuple(h[edge[i] : edge[i + 1]].tolist())) for i, x in enumerate(lines)}
            yield frame(rows, ["family", "document_id", "template", "chunks"])

    rows = texts.select("document_id", "family", "title", "section", "text").mapInPandas(go, "family string, document_id string, template string, chunks array<bigint>")
    counts = _reaching(rows.groupBy("family", "template").agg(F.count_distinct("document_id").alias("n"), F.first("chunks").alias("chunks")), need, EARLY)
    if few:
        return counts.select("family", "template")
    flat = counts.select("family", "template", F.size(F.array_distinct("chunks")).alias("k"), F.explode(F.array_distinct("chunks")).alias("h"))
    return flat.join(often, ["family", "h"]).groupBy("family", "template", "k").agg(F.count("*").alias("met")).where("met = k").select("family", "template")


_MATCHED = "chunk_id string, line_no int, document_id string, family string, t bigint"


def _matched(b: pd.DataFrame, by: dict[str, Templates]) -> pd.DataFrame:
    rows = [
        (c, i, d, f, n)
        for c, d, f, t in zip(b.chunk_id, b.document_id, b.family, b.text)
        if f in by
        for i, line in enumerate(t.split("\n"))
        for n in by[f].of(line)
    ]
    return frame(rows, ["chunk_id", "line_no", "document_id", "family", "t"])


def matches(texts: DataFrame, templates: DataFrame, bound: int, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """(chunk_id, line_no, document_id, family, t): lines and the number of each template of their family that they fit."""
    texts = texts.select("chunk_id", "document_id", "family", "text")
    numbered = templates.select("family", F.xxhash64("template").alias("t"), "template")
    if templates.count() <= bound:
        block: dict[str, list[tuple[int, str]]] = defaultdict(list)
        for r in numbered.toLocalIterator():
            block[r.family].append((r.t, r.template))
        sent = texts.sparkSession.sparkContext.broadcast(dict(block))

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by = {f: Templates(rows) for f, rows in sent.value.items()}
            for b in batches:
                yield _matched(b, by)

        return texts.mapInPandas(match, _MATCHED)
    # a family's texts are dealt out to as many groups as hold about group_texts each, and its templates go to every one of them
    parts = templates.select("family").distinct().join(texts.groupBy("family").agg(F.ceil(F.count("*") / group_texts).alias("parts")), "family")
    dealt = texts.join(parts, "family").withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts")).drop("parts")
    spread = numbered.join(parts, "family").select("family", "t", "template", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))

    def group(b: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return _matched(b, {own.family.iat[0]: Templates(list(zip(own.t, own.template)))} if len(b) and len(own) else {})

    return dealt.groupBy("family", "part").cogroup(spread.groupBy("family", "part")).applyInPandas(group, _MATCHED)


def _blank_titles(b: pd.DataFrame) -> list[str]:
    out = []
    for t, title in zip(b.text, b.title):
        p = _title_pattern(title)
        out.append(p.sub(" 0 ", t) if p else t)
    return out


def template(words: list[str]) -> str | None:
    """The line's fixed words, with # for each stretch of figures, dates, names or the title; None if too little is fixed.

    ``words`` hold a figure where the title stood.
    """
    if len(words) < 2 or sum(map(len, words)) < LEAST_LETTERS:
        return None
    cased = None
    out: list[str] = []
    fixed, last = 0, len(words) - 1
    for i, (w, low) in enumerate(zip(words, "\n".join(words).lower().split("\n"))):
        if low not in _MONTHS:
            blank = not w.isalpha()
            if not blank and i and low != w:
                if cased is None:  # letter case tells names only in a line that isn't all in capitals
                    cased = sum([x[0].isupper() for x in words]) <= 0.6 * len(words)
                blank = cased
        else:
            blank = i and not words[i - 1].isalpha() or i < last and not words[i + 1].isalpha() or i and low != w and sum([x[0].isupper() for x in words]) <= 0.6 * len(words)
        if not blank:
            out.append(low)
            fixed += len(low)
        elif not out or out[-1] != _SEP:
            out.append(_SEP)
    return " ".join(out) if fixed >= LEAST_LETTERS and len(out) > 1 else None


class Matcher:
    """Lines of a template, in normal form: lower-case words, one space between. A blank holds one word or more.

    Stretches between blanks are found from the left, each at its first place, which decides whether there is any
    way to fill the blanks without trying all of them.
    """

    def __init__(self, t: str):
        self.parts = [f" {x.strip()} " if x.strip() else "" for x in f" {t} ".split(f" {_SEP} ")]

    def fits(self, line: str) -> bool:
        s = f" {line} "
        first, last = self.parts[0], self.parts[-1]
        if len(self.parts) == 1:
            return s == first
        if not s.startswith(first):
            return False
        at = max(0, len(first) - 1)  # the space before the blank
        for x in self.parts[1:-1]:
            at = s.find(x, at + 1)
            if at < 0:
                return False
            at += len(x) - 1
        return s.endswith(last) and at < (len(s) - len(last) if last else len(s) - 1)


class Templates:
    """A family's templates, found by their first or last word."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.first: dict[str, list] = defaultdict(list)
        self.last: dict[str, list] = defaultdict(list)
        self.rest: list = []
        for n, t in rows:
            w, m = t.split(" "), (n, Matcher(t))
            (self.first[w[0]] if w[0] != _SEP else self.last[w[-1]] if w[-1] != _SEP else self.rest).append(m)

    def of(self, line: str) -> list[int]:
        m = _WORD.search(line)
        if not m:
            return []
        first = m.group().lower()
        some = self.first.get(first)
        if not some and not self.last and not self.rest:
            return []
        words = _WORD.findall(line.lower())
        flat = " ".join(words)
        hits = [n for n, p in (*(some or ()), *self.last.get(words[-1], ()), *self.rest) if p.fits(flat)]
        return hits if hits and sum(map(str.isalpha, line)) >= LEAST_LETTERS else []


def standing_lines(records: DataFrame, stats: DataFrame, titles: DataFrame | None = None, least_docs: int = LEAST_DOCS, share: float = SHARE, bound: int = BOUND, group_texts: int = GROUP_TEXTS) -> DataFrame:
    """(chunk_id, line_no, document_id): every standing line of its family."""
    ensure_checkpoint_dir(records)
    texts = _texts(records, stats, titles)
    need = needs(texts, least_docs, share).checkpoint()
    often = repeated_chunks(texts, need).checkpoint()
    templates = candidate_templates(texts, often, need, bound).checkpoint()
    hits = matches(texts, templates, bound, group_texts).distinct().checkpoint()
    good = _reaching(hits.groupBy("family", "t").agg(F.count_distinct("document_id").alias("n")), need).select("family", "t")
    return hits.join(good, ["family", "t"]).select("chunk_id", "line_no", "document_id").distinct()


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spread(spark.read.parquet(f"{sf_dir}/chunk_records.parquet")), spark.read.parquet(f"{sf_dir}/document_stats.parquet"), spark.read.parquet(f"{sf_dir}/demo_documents.parquet")


def without_lines(records: DataFrame, lines: DataFrame) -> DataFrame:
    """(chunk_id, text): each chunk's text without the lines given; chunks delivered twice come once."""
    one = records.where("chunk_id is not null").groupBy("chunk_id").agg(F.max("text").alias("text"))
    cut = lines.groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut"))  # bounded by the chunk's lines
    parts = F.split("text", "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("cut", s.i))
    return one.join(cut, "chunk_id", "left").select("chunk_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s.x), "\n")).alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standing_lines(*_tables(spark, sf_dir)).select("chunk_id", "line_no")


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, stats, titles = _tables(spark, sf_dir)
    return without_lines(records, standing_lines(records, stats, titles))


def p1_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, boilerplate): chunks of which at least half of the lines that aren't blank are standing lines."""
    records, stats, titles = _tables(spark, sf_dir)
    found = standing_lines(records, stats, titles).groupBy("chunk_id").agg(F.count("*").alias("n"))
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""))
    one = records.where("chunk_id is not null and document_id is not null").groupBy("chunk_id").agg(F.max("document_id").alias("document_id"), F.max(lines).alias("lines"))
    hit = (F.col("n") >= 0.5 * F.col("lines")).cast("int")
    return one.join(found, "chunk_id", "left").groupBy("document_id").agg(F.sum(F.coalesce(hit, F.lit(0))).cast("int").alias("boilerplate"))
