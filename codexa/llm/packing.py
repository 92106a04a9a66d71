"""Problem 7: documents into containers of fixed capacity, in tokens.

Best-two-fit: a container is filled greedily with the largest documents that
fit; then its smallest document gives way to the two unpacked documents that
fill the widened gap most tightly. Documents are spread over groups by hash and
each group is packed by itself, which leaves about one open container a group.
Only documents above the capacity are split: their full parts fill containers
alone, the rest is packed like a document.

Token counts are those of the public byte-level tokenizer whose rank file is a
parameter.

Defined results: null and empty texts have 0 tokens and a place like any other;
repeated rows are packed as often as they come.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.sources.tables import spread

CAPACITY = 2048
#: Documents that one task packs.
GROUP_ROWS = 8192
TOKENIZER = os.environ.get("CODEXA_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

# Fixed value: the pattern that this tokenizer cuts text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Counter:
    """Token counts of texts, by the lines of a rank file."""

    def __init__(self, lines: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``; none of which may exceed the capacity."""
    free: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        free.setdefault(sizes[i], []).append(i)
    zero = free.pop(0, [])
    lengths = sorted(free)  # sizes that are still unpacked

    def take(size: int) -> int:
        i = free[size].pop()
        if not free[size]:
            del free[size]
            lengths.pop(bisect_right(lengths, size) - 1)
        return i

    def give(size: int, i: int) -> None:
        if size not in free:
            free[size] = []
            insort(lengths, size)
        free[size].append(i)

    out = []
    while lengths:
        size = lengths[-1]
        bin_, gap = [(size, take(size))], capacity - size
        while gap and lengths:
            k = bisect_right(lengths, gap)
            if not k:
                break
            size = lengths[k - 1]
            bin_.append((size, take(size)))
            gap -= size
        if gap and lengths:
            small = min(bin_)
            room, best, pair = gap + small[0], small[0], None
            k = bisect_right(lengths, room) - 1
            while k >= 0 and 2 * lengths[k] > best and best < room:
                a = lengths[k]
                j = bisect_right(lengths, min(room - a, a)) - 1
                if j == k and len(free[a]) < 2:
                    j -= 1
                if j >= 0 and a + lengths[j] > best:
                    best, pair = a + lengths[j], (a, lengths[j])
                k -= 1
            if pair:
                bin_.remove(small)
                bin_ += [(s, take(s)) for s in pair]
                give(*small)
        out.append([i for _, i in sorted(bin_, key=lambda x: (-x[0], x[1]))])
    if zero:
        out = out or [[]]
        out[-1] += zero[::-1]
    return out


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, part, container, place, first_token, tokens).

    ``part`` counts the parts of a split document from 0, ``first_token`` is where the part begins in the
    document, ``place`` where it begins in its container. The rank file is read on the driver and sent along.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    groups = max(1, -(-documents.count() // group_rows))
    schema = "doc_id bigint, part int, first_token bigint, tokens int, grp bigint"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter(ranks.value)
        for b in batches:
            rows = []
            for d, g, t in zip(b.doc_id, b.grp, b.text):
                n = counter.count(t)
                full = (n - 1) // capacity if n else 0
                rows += [(d, p, p * capacity, capacity, g) for p in range(full)] + [(d, full, full * capacity, n - full * capacity, g)]
            yield frame(rows, ["doc_id", "part", "first_token", "tokens", "grp"]).astype({"doc_id": "Int64"})

    def fill(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        sizes = b.tokens.tolist()
        box, place = [0] * len(b), [0] * len(b)
        for n, members in enumerate(pack(sizes, capacity)):
            at = 0
            for i in members:
                box[i], place[i] = (int(b.grp[i]) << 32) + n, at
                at += sizes[i]
        return b.assign(container=box, place=place)[["doc_id", "part", "container", "place", "first_token", "tokens"]]

    # rows with one id, or none, are spread by their text as well
    grp = F.pmod(F.xxhash64("doc_id", F.length("text"), F.substring("text", -40, 40)), F.lit(groups))
    parts = documents.select("doc_id", grp.alias("grp"), "text").mapInPandas(cut, schema)
    return parts.groupBy("grp").applyInPandas(fill, "doc_id bigint, part int, container bigint, place int, first_token bigint, tokens int")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
