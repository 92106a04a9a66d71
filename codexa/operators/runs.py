"""Similar texts by their sets of word runs, found exactly with few bytes on the way.

Each text's distinct runs are put in one order for all texts, rarest first. Two
sets that reach a similarity must share a number of runs among the first of
both, and a set contained in another a number of its own first ones. Only those
first runs, and runs of larger texts that stand among another text's first ones,
are sent, packed by ranges of their hash: sorted hashes as differences, and of
each column only the bytes it needs. Pairs that share enough of them are
compared by their whole texts. Which runs count as frequent, and so come last,
is limited to ``MOST`` of them; any order gives the same pairs. Beyond, a map of
bits tells which runs may stand in several texts; others are never sent.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.operators.graph import ensure_checkpoint_dir, kept
from codexa.sources.tables import few

#: Ranges of hashes that rows are packed by (a power of two), and bits of the map of runs that stand among a text's first ones.
BUCKETS, BITS = 1 << 10, 1 << 27
#: Leading bits of a run's hash that are sent; runs taken for one by these only make pairs that the whole texts refute.
WIRE = 40
#: Frequent runs whose number of texts every task knows; rarer ones are ordered by their hash.
MOST = 3_000_000
#: Runs held at once before they are packed; of meetings of texts, half as many.
HELD = 4_000_000

_P, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLAIN = np.array([c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0 for c in range(256)], np.uint8)
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _order(*columns: np.ndarray) -> np.ndarray:
    """``np.lexsort`` (the last column counts first) in as few sorts as the columns' ranges allow; equal rows come in any order."""
    packed = []
    for c in columns if len(columns[0]) else ():
        c = c.astype(np.uint64) - np.uint64(int(c.min()) % (1 << 64))
        bits = int(c.max()).bit_length()
        if packed and packed[-1][1] + bits <= 64:
            packed[-1] = (packed[-1][0] | c << np.uint64(packed[-1][1]), packed[-1][1] + bits)
        else:
            packed.append((c, bits))
    order = np.argsort(packed[0][0]) if packed else np.empty(0, np.int64)
    for c, _ in packed[1:]:
        order = order[np.argsort(c[order], kind="stable")]
    return order


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        up, down = (np.full(1 << (n - 1).bit_length(), x, np.uint64) for x in (_P, _INVERSE))
        up[0] = down[0] = 1
        _POWERS.update(up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"], _POWERS["down"]


def runs_of(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct runs of ``k`` words ([a-z0-9]+ in lower case), sorted within a text, and their number by text; shorter texts have one run."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = _PLAIN[np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)]
    borders = np.cumsum([1, *(len(p) + 1 for p in parts)])
    edge = np.flatnonzero((buf[1:] > 0) != (buf[:-1] > 0)) + 1
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(buf))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(buf * up[: len(buf)], dtype=np.uint64)])
    word = _mixed((upto[end] - upto[begin]) * down[begin])
    first = np.searchsorted(begin, borders)
    words = np.diff(first)
    doc = np.repeat(np.arange(len(parts)), words)
    m = max(0, len(word) - k + 1)
    run = word[:m]
    for j in range(1, k):
        run = _mixed(run) + word[j : m + j]
    whole = doc[:m] == doc[k - 1 : m + k - 1]
    run, doc = _mixed(run[whole]), doc[:m][whole]
    few = np.flatnonzero((words > 0) & (words < k))
    if len(few):
        single = np.empty(len(few), np.uint64)
        for x, i in enumerate(few):
            h = np.array([words[i]], np.uint64)
            for w in word[first[i] : first[i + 1]]:
                h = _mixed(h) + w
            single[x] = _mixed(h)[0]
        order = np.argsort(np.concatenate([doc, few]), kind="stable")
        run, doc = np.concatenate([run, single])[order], np.concatenate([doc, few])[order]
    cuts = np.searchsorted(doc, np.arange(len(parts) + 1))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        run[i:j].sort()
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return run[new], np.bincount(doc[new], minlength=len(parts)).astype(np.int64)


PACKED = "bucket int, n int, rows binary"


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """Columns (uint64) side by side for each bucket, whose rows stand together: the lowest bytes of all rows, then the next ones, as many as are needed."""
    begin = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    end = [*begin[1:], len(bucket)]
    wide = [[(int(m).bit_length() + 7) // 8 for m in np.maximum.reduceat(c, begin)] if len(c) else [] for c in columns]
    planes = [np.ascontiguousarray(np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(-1, 8).T) for c in columns]
    rows = []
    for x, (i, j) in enumerate(zip(begin, end)):
        head = np.array([bucket[i], j - i], "<u4").tobytes() + bytes(w[x] for w in wide)
        rows.append((int(bucket[i]), int(j - i), head + b"".join(p[: w[x], i:j].tobytes() for p, w in zip(planes, wide))))
    return frame(rows, ["bucket", "n", "rows"])


def _columns(blobs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Buckets and numbers of rows of the blobs, and their ``k`` columns."""
    heads = np.array([np.frombuffer(b, "<u4", 2) for b in blobs], np.int64).reshape(-1, 2)
    out = [np.zeros((int(heads[:, 1].sum()), 8), np.uint8) for _ in range(k)]
    to = 0
    for b, n in zip(blobs, heads[:, 1].tolist()):
        at = 8 + k
        for c, w in zip(out, b[8:at]):
            if w:
                c[to : to + n, :w] = np.frombuffer(b, np.uint8, n * w, at).reshape(w, n).T
                at += n * w
        to += n
    return heads[:, 0], heads[:, 1], [c.view("<u8")[:, 0].astype(np.uint64, copy=False) for c in out]


def _added(steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums of the steps, anew from each start."""
    if not len(steps):
        return steps
    total = np.cumsum(steps, dtype=np.uint64)
    return total - np.repeat(total[starts] - steps[starts], np.diff(np.append(starts, len(steps))))


def _packed(bits: int, *columns: np.ndarray) -> pd.DataFrame:
    """Columns, the first of which is a hash of so many bits, by ranges of it."""
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order].astype(np.uint64, copy=False) for c in columns]
    shift = np.uint64(bits - BUCKETS.bit_length() + 1)
    bucket = (columns[0] >> shift).astype(np.int64)
    steps = np.diff(columns[0], prepend=np.zeros(1, np.uint64))
    begin = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.empty(0, np.int64)
    steps[begin] = columns[0][begin] & np.uint64((1 << int(shift)) - 1)
    return _blobs(bucket, steps, *columns[1:])


def _unpacked(bits: int, blobs: list[bytes], k: int) -> list[np.ndarray]:
    """The ``k`` columns of ``_packed``."""
    bucket, n, (steps, *rest) = _columns(blobs, k)
    base = np.repeat(bucket.astype(np.uint64) << np.uint64(bits - BUCKETS.bit_length() + 1), n)
    return [_added(steps, (np.cumsum(n) - n)[n > 0]) + base, *rest]


def _packed_pairs(a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> pd.DataFrame:
    """Distinct pairs of keys and what more is said of each, by the first one's hash."""
    bucket = (_mixed(a.view(np.uint64)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    order = _order(b, a, bucket)
    a, b, bucket = a[order].view(np.uint64), b[order].view(np.uint64), bucket[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    a, b, bucket, more = a[new], b[new], bucket[new], [c[order][new].astype(np.uint64, copy=False) for c in more]
    da, db = np.diff(a, prepend=np.zeros(1, np.uint64)), np.diff(b, prepend=np.zeros(1, np.uint64))
    begin = np.diff(bucket, prepend=-1) != 0
    da[begin] = a[begin]
    first = begin | (da != 0)
    db[first] = b[first] - a[first]
    db = (db << np.uint64(1)) ^ (db.view(np.int64) >> 63).view(np.uint64)  # the second may be smaller; small steps down stay small
    return _blobs(bucket, da, db, *more)


def _unpacked_pairs(blobs: list[bytes], more: int = 0) -> tuple[np.ndarray, ...]:
    _, n, (da, db, *rest) = _columns(blobs, 2 + more)
    db = (db >> np.uint64(1)) ^ (~(db & np.uint64(1)) + np.uint64(1))
    starts = (np.cumsum(n) - n)[n > 0]
    first = da != 0
    first[starts] = True
    a = _added(da, starts)
    return a.view(np.int64), (_added(db, np.flatnonzero(first)) + a).view(np.int64), *rest


def _by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[list[bytes]]:
    """The blobs of one bucket after the other; a bucket's rows stand together."""
    at, held = None, []
    for batch in batches:
        for bucket, r in zip(batch.bucket, batch.rows):
            if bucket != at and held:
                yield held
                held = []
            at = bucket
            held.append(r)
    if held:
        yield held


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    begin = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] ^ np.uint64(1)))
    return hashes[begin], np.add.reduceat(counts, begin).astype(counts.dtype) if len(begin) else counts[:0]


def _batches(batches: Iterator[pd.DataFrame], k: int) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for b in batches:
        for s in range(0, len(b), 1000):
            part = b.iloc[s : s + 1000]
            yield part, *runs_of(list(part.text), k)


def _counted(found: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]], bits: int, least: int) -> Callable:
    """From rows (a mapInPandas function gives their hashes) to packed (hash, count) of hashes that stand in at least so many."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for hashes in found(batches):
            held.append(hashes)
            n += len(hashes)
            if n >= HELD:
                yield _packed(bits, *np.unique(np.concatenate(held), return_counts=True))
                held, n = [], 0
        if n:
            yield _packed(bits, *np.unique(np.concatenate(held), return_counts=True))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, c = _summed(*_unpacked(bits, [r for b in batches for r in b.rows], 2))
        yield _packed(bits, h[c >= least], np.minimum(c[c >= least], 65_535))

    return lambda rows: rows.mapInPandas(count, PACKED).repartition("bucket").mapInPandas(add, PACKED)


def _bits(packed: DataFrame, bits: int) -> np.ndarray:
    """A map of the leading bits of packed hashes, all of a bucket's in one partition."""
    shift, each = np.uint64(bits - BITS.bit_length() + 1), BITS // BUCKETS

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.unique((_unpacked(bits, [r for b in batches for r in b.rows], 1)[0] >> shift).astype(np.int64))
        rows = []
        for bucket in np.unique(slots // each):
            marks = np.zeros(each, np.uint8)
            marks[slots[slots // each == bucket] % each] = 1
            rows.append((int(bucket), zlib.compress(np.packbits(marks).tobytes(), 1)))
        yield frame(rows, ["bucket", "bits"])

    out, size = np.zeros(BITS // 8, np.uint8), each // 8
    for r in packed.mapInPandas(mark, "bucket int, bits binary").toLocalIterator():
        out[r.bucket * size : (r.bucket + 1) * size] |= np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return out


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    return (marks[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _frequent(texts: DataFrame, k: int, most: int) -> tuple[list[bytes], np.ndarray | None]:
    """Runs in several texts, packed in their order, with the number of texts of each; where these aren't all of them, a map of all."""
    short = lambda batches: (runs >> np.uint64(64 - WIRE) for _, runs, _sizes in _batches(batches, k))
    sums = kept(_counted(short, WIRE, 2)(texts))
    total, cut = sums.agg(F.sum("n")).first()[0] or 0, 2
    if total > most:

        def spread_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = np.zeros(65_536, np.int64)
            for b in batches:
                n += np.bincount(_unpacked(WIRE, list(b.rows), 2)[1].astype(np.int64), minlength=65_536)
            yield pd.DataFrame({"c": np.flatnonzero(n), "n": n[n > 0]})

        left = total
        for r in sums.mapInPandas(spread_of, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).orderBy("c").collect():
            if left <= most:
                break
            left, cut = left - r.n, r.c + 1

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, c = _unpacked(WIRE, list(b.rows), 2)
            yield _packed(WIRE, h[c >= cut], c[c >= cut])

    # a bucket's runs stand together and in order
    blobs = [rows for _, rows in sorted((r.bucket, bytes(r.rows)) for r in sums.mapInPandas(chosen, PACKED).select("bucket", "rows").toLocalIterator())]
    return blobs, _bits(sums.select("rows").mapInPandas(_hashes, "rows binary"), WIRE) if cut > 2 else None


def _known(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``_frequent`` packed: hashes, sorted, and counts."""
    h, c = _unpacked(WIRE, blobs, 2)
    return h, c.astype(np.uint16)


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield _packed(WIRE, _unpacked(WIRE, list(b.rows), 2)[0])[["rows"]]


def _first(n: np.ndarray, share: float) -> np.ndarray:
    """Runs of a set of ``n`` that may be missing where ``share`` of it is shared."""
    return n - np.ceil(share * n - 1e-9).astype(np.int64)


def _own(n: np.ndarray, contained: float) -> np.ndarray:
    """How many first runs of a set are looked for in larger ones; all but those that may be missing must be there."""
    return np.minimum(2 * _first(n, contained) + 3, n)


def _starts(known: np.ndarray) -> np.ndarray:
    """Where, among sorted hashes of ``WIRE`` bits, those of each leading bits begin; about one each."""
    bits = max(1, len(known).bit_length())
    n = np.bincount((known >> np.uint64(WIRE - bits)).astype(np.int64), minlength=1 << bits)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int32)


def _places(known: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``np.searchsorted(known, values)``, up to the end of the values' leading bits, with few reads of memory."""
    lead = (values >> np.uint64(WIRE + 1 - len(starts).bit_length())).astype(np.int64)
    at, end = starts[lead], starts[lead + 1]
    left = np.flatnonzero(at < end)
    while len(left):
        left = left[known[at[left]] < values[left]]
        at[left] += 1
        left = left[at[left] < end[left]]
    return at


def _ordered(runs: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each text in the common order, with their text, their place from 1 and whether they are frequent."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    short = runs >> np.uint64(64 - WIRE)
    at = np.minimum(_places(frequent, starts, short), max(0, len(frequent) - 1))
    known = frequent[at] == short if len(frequent) else np.zeros(len(runs), bool)
    df = np.where(known, counts[at], 0) if len(frequent) else np.zeros(len(runs), np.int64)
    order = np.argsort(df.astype(np.uint16), kind="stable")  # of two bytes, sorts are quick
    order = order[np.argsort(doc.astype(np.uint16)[order] if len(sizes) <= 65_536 else doc[order], kind="stable")]
    return runs[order], doc, np.arange(1, len(runs) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes), known[order]


def _among_first(texts: DataFrame, k: int, contained: float, frequent) -> np.ndarray:
    """A map of runs that stand among the first ones of a text."""

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs, several = frequent.value
        known, counts = _known(blobs)
        starts = _starts(known)
        held, n = [], 0
        for _, runs, sizes in _batches(batches, k):
            run, doc, place, often = _ordered(runs, sizes, known, counts, starts)
            own = place <= _own(sizes, contained)[doc]
            run, often = run[own], often[own]
            held.append(np.unique((run[often] if several is None else run[often | _marked(several, run)]) >> np.uint64(64 - WIRE)))
            n += len(held[-1])
            if n >= HELD:
                yield _packed(WIRE, np.unique(np.concatenate(held)))
                held, n = [], 0
        if n:
            yield _packed(WIRE, np.unique(np.concatenate(held)))

    return _bits(texts.mapInPandas(firsts, PACKED).repartition("bucket"), WIRE)


def _meetings(run: np.ndarray, key: np.ndarray, n: np.ndarray, place: np.ndarray, least: float, contained: float) -> Iterator[pd.DataFrame]:
    """Packed (x, y, nx, ny - nx, near, inside): how many of these runs two texts share among the first of both, and among the smaller one's first."""
    order = _order(key, n, run)
    run, key, n, place = run[order], key[order], n[order].astype(np.int64), place[order].astype(np.int64)
    first, own = place <= _first(n, least) + 1, place <= _own(n, contained)
    found, held = [], 0

    def added() -> pd.DataFrame:
        x, y, nx, ny, near, inside = (np.concatenate(c) for c in zip(*found))
        o = _order(y, x)
        x, y = x[o], y[o]
        begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        nx, ny = nx[o][begin], ny[o][begin]
        return _packed_pairs(x[begin], y[begin], nx, ny - nx, np.add.reduceat(near[o], begin, dtype=np.int64), np.add.reduceat(inside[o], begin, dtype=np.int64))

    # a pair needs the smaller text's place, so others needn't look for larger ones
    a, j = np.flatnonzero(first | own), 1
    while len(a):
        a = a[a + j < len(run)]
        a = a[run[a] == run[a + j]]
        for s in range(0, len(a), HELD // 2):
            p = a[s : s + HELD // 2]
            q = p + j
            p, q = p[key[p] != key[q]], q[key[p] != key[q]]
            # what can be shared before and behind these places must reach the overlap
            most = np.minimum(place[p], place[q]) + np.minimum(n[p] - place[p], n[q] - place[q])
            near = first[p] & first[q] & (n[p] >= least * n[q] - 1e-9) & (most >= least / (1 + least) * (n[p] + n[q]) - 1e-6)
            inside = own[p] & (most >= contained * n[p] - 1e-6)
            ok = near | inside
            if ok.any():
                p, q = p[ok], q[ok]
                found.append((key[p], key[q], n[p].astype(np.int32), n[q].astype(np.int32), near[ok], inside[ok]))
                held += len(p)
                if held >= HELD // 2:
                    yield added()
                    found, held = [], 0
        j += 1
    if found:
        yield added()


def _near_or_inside(blobs: list[bytes], least: float, contained: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) that share enough runs in all their meetings."""
    x, y, nx, more, near, inside = _unpacked_pairs(blobs, 4)
    o = _order(y, x)
    x, y = x[o], y[o]
    begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.empty(0, np.int64)
    nx, more, near, inside = (c[o].astype(np.int64) for c in (nx, more, near, inside))
    nx, ny = nx[begin], (nx + more)[begin]
    near, inside = (np.add.reduceat(c, begin) if len(begin) else c for c in (near, inside))
    rest = lambda n: np.ceil(least * n - 1e-9) - 1
    ok = (near > 0) & (near >= np.ceil(least / (1 + least) * (nx + ny) - 1e-6) - np.maximum(rest(nx), rest(ny)))
    ok |= inside >= _own(nx, contained) - _first(nx, contained)
    return x[begin][ok], y[begin][ok]


def similar(rows: DataFrame, key: str, text: str, least: float, k: int, contained: float, most: int = MOST) -> DataFrame:
    """(a, b, la, lb, c): the smaller's and the larger's size and common runs of texts that reach ``least`` of their runs together or ``contained`` of the smaller's; keys are bigint."""
    ensure_checkpoint_dir(rows)
    sc = rows.sparkSession.sparkContext
    texts = rows.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    frequent = sc.broadcast(_frequent(texts, k, most))
    among = sc.broadcast(_among_first(texts, k, contained, frequent))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs, several = frequent.value
        known, counts = _known(blobs)
        starts, marks = _starts(known), among.value
        held, count = [], 0
        for part, runs, sizes in _batches(batches, k):
            run, doc, place, often = _ordered(runs, sizes, known, counts, starts)
            keep = (place <= _first(sizes, least)[doc] + 1) | _marked(marks, run)
            keep &= often if several is None else often | _marked(several, run)
            held.append((run[keep] >> np.uint64(64 - WIRE), part.key.to_numpy(np.int64)[doc[keep]].view(np.uint64), sizes[doc[keep]], place[keep]))
            count += int(keep.sum())
            if count >= HELD // 2:
                yield _packed(WIRE, *(np.concatenate(c) for c in zip(*held)))
                held, count = [], 0
        if count:
            yield _packed(WIRE, *(np.concatenate(c) for c in zip(*held)))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, key, n, place = _unpacked(WIRE, [r for b in batches for r in b.rows], 4)
        yield from _meetings(run, key.view(np.int64), n, place, least, contained)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for blobs in _by_bucket(batches):
            x, y = _near_or_inside(blobs, least, contained)
            yield pd.DataFrame({"x": x, "y": y})

    met = texts.mapInPandas(send, PACKED).repartition("bucket").mapInPandas(meet, PACKED)
    pairs = kept(met.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(add, "x bigint, y bigint"))
    frequent.destroy()
    among.destroy()
    # the larger text goes to a task once, before the smaller ones that may be like it; other texts stay where they are
    larger, smaller = (few(kept(pairs.select(c).distinct())) for c in ("y", "x"))
    small = texts.join(smaller, F.col("key") == F.col("x"), "left_semi").join(few(pairs), F.col("key") == F.col("x")).select("x", "y", "text", F.lit(1).alias("turn"))
    large = texts.join(larger, F.col("key") == F.col("y")).select(F.col("key").alias("x"), "y", "text", F.lit(0).alias("turn"))
    both = small.unionByName(large).repartition("y").sortWithinPartitions("y", "turn", "x")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = np.empty(0, np.uint64)
        for b in batches:
            for s in range(0, len(b), 500):
                p = b.iloc[s : s + 500]
                runs, sizes = runs_of(list(p.text), k)
                out = []
                for x, y, turn, own in zip(p.x, p.y, p.turn, np.split(runs, np.cumsum(sizes)[:-1])):
                    if turn:
                        out.append((min(x, y), max(x, y), len(own), len(of), len(np.intersect1d(own, of, assume_unique=True))))
                    else:
                        of = own
                yield frame(out, ["a", "b", "la", "lb", "c"])

    return both.mapInPandas(compare, "a bigint, b bigint, la bigint, lb bigint, c bigint")


def _minima(runs: np.ndarray, sizes: np.ndarray, permutations: int) -> np.ndarray:
    """Each text's bands, one row each: hashes of two minima of its runs (of one or more)."""
    starts, out = np.cumsum(sizes) - sizes, np.empty((len(sizes), permutations // 2), np.uint64)
    least = lambda i: np.minimum.reduceat(_mixed(np.array([2 * i + 1], np.uint64)) ^ runs * (_mixed(np.array([2 * i + 2], np.uint64)) | np.uint64(1)), starts)
    for j in range(permutations // 2):
        out[:, j] = _mixed(_mixed(least(2 * j) + np.uint64(j)) + least(2 * j + 1))
    return out


def banded(rows: DataFrame, key: str, text: str, k: int, permutations: int, hot: int, exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): distinct pairs of texts that share a band of two minima of their runs, and ``exact`` pairs of texts in bands that more than ``hot`` share; keys are bigint.

    Hashes of bands are counted before; only bands that several texts may share are sent with their texts.
    """
    ensure_checkpoint_dir(rows)
    sc = rows.sparkSession.sparkContext
    texts = rows.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part, runs, sizes in _batches(batches, k):
            some = sizes > 0
            if some.any():
                yield part.key.to_numpy(np.int64)[some], _minima(runs, sizes[some], permutations)

    def burning(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, c = _unpacked(64, list(b.rows), 2)
            yield _packed(64, h[c > hot])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _packed(64, _unpacked(64, list(b.rows), 2)[0])

    shared = _counted(lambda batches: (h.ravel() for _, h in bands(batches)), 64, 2)(texts).checkpoint()
    warm = sc.broadcast(np.sort(_unpacked(64, [bytes(r.rows) for r in shared.mapInPandas(burning, PACKED).select("rows").toLocalIterator()], 1)[0]))
    marks = sc.broadcast(_bits(shared.mapInPandas(hashes, PACKED), 64))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for keys, h in bands(batches):
            keys, h = np.repeat(keys, h.shape[1]), h.ravel()
            keep = _marked(marks.value, h) & ~_within(warm.value, h)
            held.append((h[keep], keys[keep].view(np.uint64)))
            n += int(keep.sum())
            if n >= HELD // 2:
                yield _packed(64, *(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if n:
            yield _packed(64, *(np.concatenate(c) for c in zip(*held)))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, key = _unpacked(64, [r for b in batches for r in b.rows], 2)
        key = key.view(np.int64)
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        a, j, held, n = np.arange(len(h)), 1, [], 0
        while len(a):
            a = a[a + j < len(h)]
            a = a[h[a] == h[a + j]]
            held.append((key[a], key[a + j]))
            n += len(a)
            if n >= HELD:
                yield _packed_pairs(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
            j += 1
        if n:
            yield _packed_pairs(*(np.concatenate(c) for c in zip(*held)))

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each pair of a bucket once."""
        for blobs in _by_bucket(batches):
            a, b = _unpacked_pairs(blobs)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
            yield pd.DataFrame({"a": a[new], "b": b[new]})

    def in_warm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for keys, h in bands(batches):
            yield pd.DataFrame({"key": keys[_within(warm.value, h.ravel()).reshape(h.shape).any(1)]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _packed_pairs(b.a.to_numpy(np.int64), b.b.to_numpy(np.int64))

    met = texts.mapInPandas(send, PACKED).repartition("bucket").mapInPandas(meet, PACKED)
    if len(warm.value):
        hot_texts = texts.join(few(texts.mapInPandas(in_warm, "key bigint").distinct().checkpoint()), "key", "left_semi")
        met = met.unionByName(exact(hot_texts).select("a", "b").mapInPandas(pack, PACKED))
    return met.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(once, "a bigint, b bigint")


def _within(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
