"""Problem 3: text from scanned pages made into continuous paragraphs.

1. A hidden Markov model labels each line as running header, page number
   (break), body, or body that ends inside a word (split), by layout features.
   It is fitted by counting on at most ``fit_rows`` chunks, labelled weakly by
   page-number shapes, titles and marks at line ends.
2. Words are counted over all chunks. A word that the usual confusions of
   characters turn into one at least ``RATIO`` times as frequent was misread;
   candidates meet in a join on a form in which confused characters fall
   together. Counts of a word and of its parts also tell words broken at line
   ends from compounds.
3. Body lines are joined into paragraphs; the words of lines labelled split,
   also across headers and page numbers, are put together where the counts
   bear it out.

Misreadings and broken words are a table. Where it is counted to hold at most
``bound`` rows it is sent to the tasks; where it holds more, each chunk gets its
rows by a join. The results are the same either way.

Defined results: null texts stay null and have no defects; a chunk delivered
twice counts once; texts that aren't wrapped keep their lines.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.operators.graph import ensure_checkpoint_dir
from codexa.sources.tables import spread

#: Chunks the line model is fitted on, and rows of the table of words that are sent to the tasks; more are joined.
FIT_ROWS, BOUND = 4000, 300_000
#: A misreading is at least so many times rarer than the word it stands for.
RATIO = 20

# What is read for what in scanned print.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("$", "s"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("q", "g"), ("g", "q"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("l", "i"), ("i", "l"),
    ("o", "0"), ("l", "1"), ("s", "5"), ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"),
    ("li", "h"), ("h", "li"), ("ri", "n"), ("n", "ri"), ("nn", "m"), ("m", "nn"), ("ll", "u"), ("c", "o"), ("o", "c"), ("z", "2"), ("2", "z"), ("ln", "m"), ("tn", "m"),
]
MARKS = "-‐‑¬­–"

_BY_SEEN: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _s, _t in CONFUSIONS:
    _BY_SEEN[_s[0]].append((_s, _t))
_TOKEN = re.compile(r"[!|]?[^\W_]+(?:[!|][^\W_]+)*(?:[-'’][!|]?[^\W_]+(?:[!|][^\W_]+)*)*")
_BROKEN = re.compile(rf"([!|]?[^\W_]+(?:[-'’!|][^\W_]+)*)([{MARKS}])\s*$")
_NUMBER = re.compile(r"\s*(?:[-–—\[(|•·*~]\s*)?(?:page|pg\.?|p\.)?\s*\d{1,4}\s*(?:(?:of|/)\s*\d{1,4}\s*)?(?:[-–—\])|•·*~]\s*)?$", re.I)
_WORD = re.compile(r"[^\W_]+")
_CODED = frozenset("+=/\\@&<{}~^")
STATES = ("body", "header", "break", "split")
#: States whose lines belong to the text.
TEXT = (0, 3)


def explains(seen: str, true: str, most: int = 4) -> list[int] | None:
    """Positions in ``seen`` of the confusions that turn ``true`` into it; None if there is no such way."""
    memo: set[tuple[int, int, int]] = set()

    def go(i: int, j: int, left: int) -> list[int] | None:
        if i == len(seen) and j == len(true):
            return []
        if i >= len(seen) or j > len(true) or (i, j, left) in memo:
            return None
        if j < len(true) and seen[i] == true[j]:
            r = go(i + 1, j + 1, left)
            if r is not None:
                return r
        if left:
            for s, t in _BY_SEEN.get(seen[i], ()):
                if seen.startswith(s, i) and true.startswith(t, j):
                    r = go(i + len(s), j + len(t), left - 1)
                    if r is not None:
                        return [i, *r]
        memo.add((i, j, left))
        return None

    return go(0, 0, most)


# single characters that are taken for one another fall together; the others are tried one by one
_CLASSES = ("o0ce", "l1i!|", "tf", "s5$", "hb86", "gq9", "nu", "z2")
_FROM, _TO = "".join(g[1:] for g in _CLASSES), "".join(g[0] * (len(g) - 1) for g in _CLASSES)
_CANON = str.maketrans(_FROM, _TO)
_LONG = [(s, t) for s, t in CONFUSIONS if len(s) + len(t) > 2]


def _variants(word: str) -> set[str]:
    """The word, and the word with one kind of longer confusion undone, at one place or everywhere."""
    out = {word}
    for s, t in _LONG:
        at = word.find(s)
        if at < 0:
            continue
        out.add(word.replace(s, t))
        while at >= 0:
            out.add(word[:at] + t + word[at + len(s) :])
            at = word.find(s, at + 1)
    return out


def corrections(words: DataFrame) -> DataFrame:
    """(key, word, at): misreadings among (word, n), the word each stands for, and where it was misread."""

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, w, n) for w, n in zip(b.word, b.n) if sum(map(str.isalpha, w)) >= max(2, len(w) // 2) for f in {v.translate(_CANON) for v in _variants(w)}]
            yield frame(rows, ["form", "key", "own"])

    def explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, w, n, at) for k, w, n in zip(b.key, b.word, b.n) if (at := explains(k, w, max(1, len(k) // 3)))]
            yield frame(rows, ["key", "word", "n", "at"])

    seen = words.where(F.length("word").between(3, 24)).mapInPandas(forms, "form string, key string, own bigint")
    true = words.where((F.col("n") >= RATIO) & (F.length("word") >= 3) & F.col("word").rlike(r"^\p{L}+$")).select(F.translate("word", _FROM, _TO).alias("form"), "word", "n")
    met = seen.join(true, "form").where((F.col("n") >= RATIO * F.greatest("own", F.lit(1))) & (F.col("key") != F.col("word"))).select("key", "word", "n").distinct()
    ways = met.mapInPandas(explained, "key string, word string, n bigint, at array<int>")
    return ways.groupBy("key").agg(F.max_by(F.struct("word", "at"), F.struct("n", "word")).alias("x")).select("key", "x.word", "x.at")


_PLAIN = bytes(ord(chr(i).lower()) if chr(i).isascii() and (chr(i).isalnum() or chr(i) in "-'!|") else 32 for i in range(256))
_LINE_END = re.compile(rf"\S*[{MARKS}][^\S\n]*\n\s*\S*")


class Tally:
    """Counts of words and hyphenated words of texts, without those at broken line ends."""

    def __init__(self):
        self.raw: Counter[str] = Counter()
        self.named: set[str] = set()

    def add(self, text: str) -> None:
        ends = _LINE_END.findall(text)
        if ends:
            self.named.update(t for x in ends for t in _TOKEN.findall(x.lower()))
            text = _LINE_END.sub(" ", text)
        self.raw.update(text.encode().translate(_PLAIN).decode().split() if text.isascii() else _TOKEN.findall(text.lower()))

    def rows(self) -> list[tuple[int, str, int]]:
        """(0, word, n) so far, parts of hyphenated words included; words only named have a count of 0."""
        out: Counter[str] = Counter()
        for w, n in self.raw.items():
            for t in [w] if w.isalnum() else _TOKEN.findall(w):
                out[t] += n
                for x in t.split("-") if "-" in t else ():
                    out[x] += n
        for t in self.named:
            for x in {t, *t.split("-")}:
                out[x] += 0
        self.raw.clear()
        self.named.clear()
        return [(0, w, n) for w, n in out.items()]


def broken_key(before: str, after: str) -> str:
    return f"{before}\n{after}".lower()


def word_facts(rows: DataFrame, repair: Repair) -> DataFrame:
    """(key, word, at) over all rows: misreadings as ``corrections`` gives them, and keys of hyphens that break a word."""
    sent = rows.sparkSession.sparkContext.broadcast(repair)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, asked = Tally(), set()
        for b in batches:
            for d, p, t, title, image in zip(b.document_id, b.pages, b.text, b.title, b.image_only_pages):
                tally.add(t)
                for _, _, m, n in sent.value.ends(t, d, title, p, image):
                    tally.named.add((m.group(1) + n.group()).lower())
                    if m.group(2) == "-":
                        asked.add((1, broken_key(m.group(1), n.group()), 0))
            if len(tally.raw) + len(asked) > 1_000_000:
                yield frame([*tally.rows(), *asked], ["kind", "word", "n"])
                asked.clear()
        yield frame([*tally.rows(), *asked], ["kind", "word", "n"])

    found = rows.where("text is not null").mapInPandas(go, "kind int, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")).checkpoint()
    words = found.where("kind = 0").select("word", "n")
    fixes = corrections(words).checkpoint()
    asked = found.where("kind = 1").select(F.col("word").alias("key"))
    before, after = F.substring_index("key", "\n", 1), F.substring_index("key", "\n", -1)
    left, right = F.substring_index(before, "-", -1), F.substring_index(after, "-", 1)
    parts = {"whole": F.concat(before, after), "compound": F.concat_ws("-", before, after), "joined": F.concat(left, right), "left": left, "right": right}
    roles = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), v.alias("word")) for k, v in parts.items()])).alias("x")
    counts = asked.select("key", roles).select("key", "x.role", "x.word").join(words, "word", "left")
    n = {k: F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(k) for k in parts}
    told = counts.groupBy("key").agg(*n.values(), F.max(F.when(F.col("role") == "whole", F.col("word"))).alias("w"))
    told = told.join(fixes.select(F.col("key").alias("w"), F.lit(True).alias("fixed")), "w", "left")
    # known words decide; else parts that are words of their own, and nothing known when put together, make a compound
    known = (F.col("whole") > 0) | (F.col("compound") > 0)
    own = (F.col("left") >= RATIO) & (F.col("right") >= RATIO)
    broken = F.when(known, F.col("whole") >= F.col("compound")).when(F.col("fixed"), True).otherwise((F.col("joined") > 0) | ~own)
    return fixes.unionByName(told.where(broken).select("key", F.lit(None).cast("string").alias("word"), F.lit(None).cast("array<int>").alias("at"))).checkpoint()


class Layout:
    """Layout features of a chunk's lines."""

    def __init__(self, document_id: str | None, title: str | None):
        self.title = [w.lower() for w in _WORD.findall(title or "")]
        self.names = set(re.findall(r"[a-z]{4,}", (document_id or "").lower())[-1:])  # the id ends with the name of what the document is for

    def marks(self, line: str, words: list[str]) -> tuple[int, int, int]:
        """Whether the line is a number, the title, or ends with the document's own name; -1 where it can't be told."""
        number = int(len(line) < 40 and bool(_NUMBER.match(line)))
        if not self.title and not self.names or len(words) > len(self.title) + 8 and len(words) > 24:
            return number, 0 if self.title else -1, 0
        core = [w.lower() for w in words]
        if core and (core[-1] == "continued" or core[-1].isdigit()):
            core.pop()
        if core and core[0].isdigit():
            core.pop(0)
        # a header may break off, so most of the title from its begin on will do
        title = -1 if not self.title else int(len(core) >= max(1, 0.6 * len(self.title)) and core == self.title[: len(core)])
        name = int(len(core) >= 4 and not self.names.isdisjoint(core[-2:]) and "for" in core[:-1])
        return number, title, name

    def features(self, lines: list[str], scanned: bool) -> list[tuple[int, ...] | None]:
        """Of each line; None for a blank one. Each feature is a small number, -1 where it can't be told."""
        width = max(1, _width(lines))
        held = [i for i, x in enumerate(lines) if x and not x.isspace()]
        same = Counter(lines[i].strip() for i in held)
        out: list[tuple[int, ...] | None] = [None] * len(lines)
        for k, i in enumerate(held):
            line = lines[i]
            words = _WORD.findall(line)
            caps = int(len(words) < 25 and sum([w[0].isupper() for w in words]) > 0.9 * len(words))
            edge = 0 if k == 0 else 1 if k == len(held) - 1 else 2
            alone = int((i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip()))
            end = line.rstrip()
            cut = int(end[-1] in MARKS and end[-2:-1].isalnum() and k < len(held) - 1)
            out[i] = (*self.marks(line, words), caps, int(end[-1] in ".;:?!"), min(2, 3 * len(line) // width), int(scanned), edge, alone, int(same[line.strip()] > 1), cut)
        return out


class LineModel:
    """A hidden Markov model over the lines of a chunk, with independent features."""

    SIZES = (2, 2, 2, 2, 2, 3, 2, 3, 2, 2, 2)
    #: Features that hardly are smoothed, as nothing else tells furniture and broken ends.
    TELLING = (0, 1, 2, 10)

    def __init__(self):
        self.start = np.zeros(len(STATES))
        self.move = np.zeros((len(STATES), len(STATES)))
        self.emit = [np.zeros((len(STATES), k)) for k in self.SIZES]
        self.known: dict[tuple[int, ...], list[float]] = {}

    def fit(self, chunks: list[list[tuple[tuple[int, ...], int]]]) -> LineModel:
        """Smoothed counts; ``chunks`` hold (features, state) of each line."""
        start, move = np.ones(len(STATES)), np.ones((len(STATES), len(STATES)))
        emit = [np.full((len(STATES), k), 0.02 if j in self.TELLING else 0.5) for j, k in enumerate(self.SIZES)]
        for lines in chunks:
            before = None
            for f, s in lines:
                if before is None:
                    start[s] += 1
                else:
                    move[before, s] += 1
                before = s
                for e, v in zip(emit, f):
                    if v >= 0:
                        e[s, v] += 1
        self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]
        return self

    def label(self, lines: list[tuple[int, ...]]) -> list[int]:
        """The most likely states (Viterbi)."""
        if not lines:
            return []
        move, known = self.move.T.tolist(), self.known
        back: list[tuple[int, ...]] = []
        score: list[float] = []
        for f in lines:
            own = known.get(f)
            if own is None:
                own = known[f] = sum((e[:, v] for e, v in zip(self.emit, f) if v >= 0), np.zeros(len(STATES))).tolist()
            if not score:
                score = [a + b for a, b in zip(self.start.tolist(), own)]
                continue
            best = [max((s + m, k) for k, (s, m) in enumerate(zip(score, row))) for row in move]
            back.append(tuple(k for _, k in best))
            score = [v + x for (v, _), x in zip(best, own)]
        path = [max(range(len(STATES)), key=score.__getitem__)]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]


def _width(lines: list[str]) -> int:
    long = sorted(len(x) for x in lines if x.strip())
    return long[int(0.9 * (len(long) - 1))] if long else 0


def _scanned(pages, image_pages) -> bool:
    return pages is not None and image_pages is not None and not {*pages}.isdisjoint({*image_pages})


def fit_lines(rows: list) -> LineModel:
    """A model from rows of (document_id, title, pages, image_only_pages, text), labelled weakly."""
    chunks = []
    for r in rows:
        fs = [f for f in Layout(r.document_id, r.title).features(r.text.split("\n"), _scanned(r.pages, r.image_only_pages)) if f]
        chunks.append([(f, 2 if f[0] else 1 if f[1] == 1 or f[1] == -1 and f[2] else 3 if f[10] else 0) for f in fs])
    # every state is seen in its plain shape, body lines at every place and of every length
    plain = [((0, 0, 0, 0, end, wide, scan, edge, 0, 0, cut), 3 * cut) for cut in (0, 1) for _ in range(5 - 3 * cut) for end in (0, 1) for wide in range(3) for scan in (0, 1) for edge in range(3)]
    plain += [((0, 1, 1, 1, 0, 2, 1, 2, 0, 0, 0), 1), *plain[:2], ((1, 0, 0, 0, 0, 0, 1, 2, 0, 0, 0), 2)]
    return LineModel().fit([*chunks, plain])


class Repair:
    """Defects of a chunk's lines, and its text without them.

    ``facts`` has the misreadings, as (word, at) by key, and the keys of hyphens that break a word.
    """

    def __init__(self, model: LineModel, facts: dict[str, tuple[str | None, list[int] | None]] | None = None):
        self.model, self.facts = model, facts or {}

    def labels(self, lines: list[str], lay: Layout, scanned: bool) -> list[int | None]:
        """The state of each line; None for blank ones."""
        fs = lay.features(lines, scanned)
        path = iter(self.model.label([f for f in fs if f]))
        return [f and next(path) for f in fs]

    def _ends(self, lines: list[str], states: list[int | None]) -> list[tuple[int, int, re.Match, re.Match]]:
        """(line, line its word may go on in, match of the first part, match of the second) of lines labelled split."""
        out = []
        body = [i for i, s in enumerate(states) if s in TEXT]
        for i, j in zip(body, body[1:]):
            m = states[i] == 3 and _BROKEN.search(lines[i])
            n = m and _TOKEN.match(lines[j].lstrip())
            if n and m.group(1)[-1:].isalnum() and (n.group()[:1].islower() or n.group()[:1] in "!|015"):
                out.append((i, j, m, n))
        return out

    def ends(self, text: str, document_id, title, pages, image_pages) -> list[tuple[int, int, re.Match, re.Match]]:
        if not _LINE_END.search(text):
            return []
        lines = text.split("\n")
        return self._ends(lines, self.labels(lines, Layout(document_id, title), _scanned(pages, image_pages)))

    def keys(self, text: str, *about) -> set[str]:
        """What must be looked up in the facts for a text."""
        out = {x for w in set(_TOKEN.findall(text.lower())) for x in (w, *w.split("-"))}
        for _, _, m, n in self.ends(text, *about):
            whole = (m.group(1) + n.group()).lower()
            out |= {broken_key(m.group(1), n.group()), whole, *whole.split("-")}
        return out

    def look(self, document_id, title, pages, image_pages, text: str):
        """(lines, states, breaks, fixes): breaks maps a line to the line its word goes on in; fixes are (line, begin, end, word)."""
        lines = text.split("\n")
        states = self.labels(lines, Layout(document_id, title), _scanned(pages, image_pages))
        breaks: dict[int, int] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        fixes = []
        for i, j, m, n in self._ends(lines, states):
            if m.group(2) != "-" or broken_key(m.group(1), n.group()) in self.facts:
                breaks[i] = j
                shift = len(lines[j]) - len(lines[j].lstrip())
                spans.setdefault(i, []).append(m.span(1))
                spans.setdefault(j, []).append((shift, shift + n.end()))
                c = self._fix((m.group(1) + n.group()).lower())
                if c:
                    cut = len(m.group(1))
                    if any(p < cut for p in c[1]):
                        fixes.append((i, *m.span(1), c[0][:cut]))
                    if any(p >= cut for p in c[1]):
                        fixes.append((j, shift, shift + n.end(), c[0][cut:]))
        wrong = {w: c[0] for w in set(_TOKEN.findall(text.lower())) if (c := self._fix(w))}
        if wrong:
            for i, line in enumerate(lines):
                for t in _TOKEN.finditer(line) if states[i] is not None else ():
                    w = wrong.get(t.group().lower())
                    # stretches of encoded text hold chance look-alikes
                    coded = line[t.start() - 1 : t.start()] in _CODED or line[t.end() : t.end() + 1] in _CODED
                    if w and not coded and t.span() not in spans.get(i, ()):
                        fixes.append((i, *t.span(), w))
        return lines, states, breaks, fixes

    def _fix(self, w: str) -> tuple[str, list[int]] | None:
        c = self.facts.get(w)
        if c or "-" not in w:
            return c
        at, out, hit = 0, [], []
        for part in w.split("-"):
            c = self.facts.get(part)
            out.append(c[0] if c else part)
            hit += [at + p for p in c[1]] if c else []
            at += len(part) + 1
        return ("-".join(out), hit) if hit else None

    def text(self, document_id, title, pages, image_pages, text: str) -> str:
        """The text as paragraphs: furniture out, broken and misread words whole."""
        lines, states, breaks, fixes = self.look(document_id, title, pages, image_pages, text)
        new = list(lines)
        for i, s, e, w in sorted(fixes, key=lambda x: (x[0], -x[1])):
            old = lines[i][s:e]
            new[i] = new[i][:s] + (w.upper() if old.isupper() and len(old) > 1 else w.capitalize() if old[:1].isupper() else w) + new[i][e:]
        body = [i for i, s in enumerate(states) if s in TEXT]
        wrapped = breaks or sum(lines[j][:1].islower() for j in body[1:]) >= 0.3 * max(1, len(body) - 1)
        out: list[str] = []
        glue = False
        for k, i in enumerate(body):
            line = new[i].strip() if wrapped else new[i]
            gap = k > 0 and any(states[x] is None for x in range(body[k - 1], i))
            furniture = k > 0 and any(states[x] in (1, 2) for x in range(body[k - 1] + 1, i))
            goes_on = out and not re.search(r"[.!?:][\"'”’)]*$", out[-1])
            if not out:
                out.append(line)
            elif glue:
                out[-1] += line
            elif not wrapped:
                out += ["", line] if gap else [line]
            elif gap and not (furniture and goes_on):
                out += ["", line]
            elif line[:1].islower() or len(lines[body[k - 1]]) > 0.6 * _width(lines):
                out[-1] += " " + line
            else:
                out.append(line)
            glue = i in breaks
            if glue:
                out[-1] = re.sub(rf"[{MARKS}]\s*$", "", out[-1])
            elif wrapped and k + 1 < len(body) and re.search(r"[^\W\d_]-$", out[-1]) and lines[body[k + 1]].lstrip()[:1].islower():
                glue = True  # a compound parted at its own hyphen
        return "\n".join(out)


def _inputs(records: DataFrame, documents: DataFrame) -> DataFrame:
    one = documents.where("document is not null").groupBy("document").agg(F.max("title").alias("title"), F.flatten(F.collect_set("image_only_pages")).alias("image_only_pages"))
    rows = records.where("chunk_id is not null").select("chunk_id", "document_id", "pages", "text")
    return rows.join(one, rows.document_id == one.document, "left").select("chunk_id", "document_id", "pages", "text", "title", "image_only_pages")


def _repaired(rows: DataFrame, each, schema: str, fit_rows: int, bound: int) -> DataFrame:
    """What ``each(repair, chunk_id, text, document_id, title, pages, image_only_pages)`` yields of all rows."""
    ensure_checkpoint_dir(rows)
    # twice the sample by hash first, so that what tasks send to the driver stays about that, however many tasks there are
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 40))
    named = rows.where("text is not null and title is not null")
    share = math.ceil(min(1.0, 2 * fit_rows / max(1, named.select("title").count())) * (1 << 40))
    sample = named.where(place < share).orderBy(place, "text").limit(fit_rows).collect()
    plain = Repair(fit_lines(sample))
    facts = word_facts(rows, plain)
    few = facts.count() <= bound
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(Repair(plain.model, {r.key: (r.word, r.at) for r in facts.toLocalIterator()} if few else None))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(c, k) for c, d, p, t, title, image in zip(b.chunk_id, b.document_id, b.pages, b.text, b.title, b.image_only_pages) for k in sent.value.keys(t, d, title, p, image)]
            yield frame(out, ["chunk_id", "key"])

    names = [x.split()[0] for x in schema.split(", ")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):  # texts in and out are held twice, so not too many at a time
                out = []
                part = b.iloc[s : s + 500]
                for c, d, p, t, title, image, own in zip(part.chunk_id, part.document_id, part.pages, part.text, part.title, part.image_only_pages, part.facts):
                    repair = sent.value if few else Repair(sent.value.model, {x["key"]: (x["word"], x["at"]) for x in own} if own is not None else None)
                    out += each(repair, c, t, d, title, p, image)
                yield frame(out, names)

    if few:
        return rows.withColumn("facts", F.lit(None).cast("array<struct<key:string>>")).mapInPandas(go, schema)
    asked = rows.where("text is not null").mapInPandas(keys, "chunk_id string, key string").distinct()
    own = asked.join(facts, "key").groupBy("chunk_id").agg(F.collect_list(F.struct("key", "word", "at")).alias("facts"))  # bounded by the chunk's words
    return rows.join(own, "chunk_id", "left").mapInPandas(go, schema)


def line_defects(records: DataFrame, documents: DataFrame, fit_rows: int = FIT_ROWS, bound: int = BOUND) -> DataFrame:
    """(chunk_id, line_no, defect): split_word, misread or page_furniture."""

    def each(repair: Repair, chunk, text, *about):
        if text is None:
            return set()
        _, states, breaks, fixes = repair.look(*about, text)
        out = {(chunk, i, "page_furniture") for i, s in enumerate(states) if s in (1, 2)}
        return sorted(out | {(chunk, i, "split_word") for i in breaks} | {(chunk, f[0], "misread") for f in fixes})

    return _repaired(_inputs(records, documents), each, "chunk_id string, line_no int, defect string", fit_rows, bound).distinct()


def repaired_text(records: DataFrame, documents: DataFrame, fit_rows: int = FIT_ROWS, bound: int = BOUND) -> DataFrame:
    """(chunk_id, text): each chunk once, its text as continuous paragraphs."""

    def each(repair: Repair, chunk, text, *about):
        return [(chunk, None if text is None else repair.text(*about, text))]

    out = _repaired(_inputs(records, documents), each, "chunk_id string, text string", fit_rows, bound)
    return out.groupBy("chunk_id").agg(F.max("text").alias("text"))


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spread(spark.read.parquet(f"{sf_dir}/chunk_records.parquet")), spark.read.parquet(f"{sf_dir}/demo_documents.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_defects(*_tables(spark, sf_dir))


def p3_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_text(*_tables(spark, sf_dir))
