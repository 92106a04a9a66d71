"""Problem 8: evaluation texts that leak into training text.

Wu-Manber search over words: the shift table is keyed by blocks of two words,
a block that ends no pattern prefix lets the window jump, a block that does
opens the bucket of patterns with that suffix, and direct comparison confirms.
Patterns are aligned stretches of the items, half as long as a leak must be.
Both sides are compared in the consistent form of problem 9.

Defined results: null or empty texts and items hold nothing; an item set twice
counts under both ids; a document that repeats a passage gives one row.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.llm.consistent import Bigrams, consistent, fit_model
from codexa.operators.graph import ensure_checkpoint_dir
from codexa.sources.tables import spread

#: Consecutive words that count as a leak.
RUN = 12
#: Characters of items searched for in one pass, so that the table sent to the executors is bounded.
PASS_CHARS = 16_000_000

_WORDS = re.compile(r"[^\W_]+")
_PLAIN = bytes(ord(chr(i).lower()) if chr(i).isascii() and chr(i).isalnum() else 32 for i in range(256))


def words(text: str) -> list:
    """Lower-case runs of letters and digits, as bytes."""
    if text.isascii():
        return text.encode().translate(_PLAIN).split()
    return [w.encode() for w in _WORDS.findall(text.lower())]


def texts_of(question: str | None, passage: str | None, run: int = RUN) -> set[tuple[bytes, ...]]:
    """The word sequences to search for: either text if it has ``run`` words, and a shorter question."""
    q, p = tuple(words(question or "")), tuple(words(passage or ""))
    return {w for w, whole in ((q, True), (p, False)) if len(w) >= run or whole and w}


class WuManber:
    """Many word sequences, searched for at once.

    ``run`` consecutive words of a longer text always hold one of the blocks of (run + 1) // 2 words that begin at
    multiples of that length, so only those blocks are patterns, and a block that is met is extended to either side.
    Shorter texts are patterns as a whole. They have tables of their own, by length, so that a short one doesn't
    shorten the jumps of the others.
    """

    def __init__(self, texts: dict[tuple[bytes, ...], list[int]], run: int = RUN):
        self.run, self.texts, self.ids = run, [], list(texts.values())
        self.vocabulary: dict[bytes, int] = {}
        self.tables = []
        classes: dict[int, list[tuple[list[int], int, int]]] = defaultdict(list)
        for n, t in enumerate(texts):
            w = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in t]
            self.texts.append(w)
            if len(w) < run:
                classes[len(w).bit_length()].append((w, n, -1))
                continue
            m, seen = (run + 1) // 2, set()
            for at in range(0, len(w) - m + 1, m):
                around = tuple(w[max(0, at + m - run) : at + run]), min(at, run - m)
                if around not in seen:
                    seen.add(around)
                    classes[0].append((w[at : at + m], n, at))
        self.base = len(self.vocabulary) + 1
        for mine in classes.values():
            least = min(len(p) for p, _, _ in mine)
            block = min(2, least)
            shift: dict[int, int] = {}
            bucket: dict[int, list] = defaultdict(list)
            for p, n, at in mine:  # suffix buckets lie at the end of each pattern's first ``least`` words
                for j in range(block - 1, least):
                    key = self._key(p, j, block)
                    shift[key] = min(shift.get(key, least), least - 1 - j)
                bucket[self._key(p, least - 1, block)].append((p, n, at))
            self.tables.append((block, least, shift, dict(bucket)))

    def _key(self, w: list[int], i: int, block: int) -> int:
        return w[i] if block == 1 else w[i - 1] * self.base + w[i]

    def _confirmed(self, w: list[int], start: int, text: list[int], at: int, size: int) -> bool:
        """Whether the block met at ``start`` belongs to a common run that is long enough."""
        left = right = 0
        need = self.run - size
        while left < need and start > left and at > left and w[start - left - 1] == text[at - left - 1]:
            left += 1
        i, j = start + size, at + size
        while left + right < need and i + right < len(w) and j + right < len(text) and w[i + right] == text[j + right]:
            right += 1
        return left + right >= need

    def search(self, found_in: list[bytes]) -> set[int]:
        """The ids whose texts occur in the words."""
        known = self.vocabulary.get
        w = [known(x, 0) for x in found_in]
        found: set[int] = set()
        for block, least, shift, bucket in self.tables:
            i, n, jump = least - 1, len(w), least - block + 1
            while i < n:
                if not w[i]:  # a word of no pattern
                    i += least
                    continue
                key = self._key(w, i, block)
                step = shift.get(key, jump)
                if step:
                    i += step
                    continue
                start = i - least + 1
                for p, t, at in bucket[key]:
                    if t not in found and w[start : start + len(p)] == p and (at < 0 or self._confirmed(w, start, self.texts[t], at, len(p))):
                        found.add(t)
                i += 1
        return {x for t in found for x in self.ids[t]}


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN, model: Bigrams | None = None, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id): documents that hold ``run`` words of an item, or a shorter question whole.

    Items are searched for in passes of about ``pass_chars`` characters. Of several passes, one runs after the other
    and writes its rows, so neither the driver nor a task ever holds more than one pass.
    """
    model = fit_model(documents) if model is None else model
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    sc, schema = documents.sparkSession.sparkContext, "doc_id bigint, item_id bigint"
    items = items.where(F.col("item_id").isNotNull()).select("item_id", "question", "passage")
    chars = F.coalesce(F.length("question"), F.lit(0)) + F.coalesce(F.length("passage"), F.lit(0))
    passes = max(1, -(-(items.agg(F.sum(chars.cast("bigint"))).first()[0] or 0) // pass_chars))
    if passes > 1:
        ensure_checkpoint_dir(documents)
    out = None
    for k in range(passes):
        table: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for item, q, p in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k).toLocalIterator():
            for t in texts_of(consistent(q, model)[0], consistent(p, model)[0], run):
                table[t].append(item)
        sent = sc.broadcast(WuManber(table, run))
        part = docs.mapInPandas(_searcher(sent, model), schema)
        if passes > 1:
            part = part.distinct().checkpoint()
            sent.destroy()
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def _searcher(sent, model: Bigrams):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i) for d, t in zip(b.doc_id, b.text) for i in sent.value.search(words(consistent(t, model)[0]))]
            yield frame(rows, ["doc_id", "item_id"]).astype("int64")

    return search


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/eval_items.parquet")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(*_tables(spark, sf_dir))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return leaked_items(*_tables(spark, sf_dir)).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc_id"))
