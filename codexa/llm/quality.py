"""Problem 6: text quality measures, and what kind of text a chunk is.

The measures of each text feed gradient-boosted trees, fitted on at most
``fit_rows`` chunks that rules label weakly as prose, contents, form, listing
or junk; texts the rules aren't sure of stay unlabelled. In a part of the
fitted texts the measures that their label was taken from are hidden, so the
trees have to learn what else tells a kind. Their scores are turned into
probabilities by a temperature and an offset for each kind, fitted on a small
hand-checked holdout; the most probable kind after that is taken. Prose of fewer than ``TINY_WORDS`` words is tiny.

Defined results: null and empty texts are tiny, with measures of 0; a chunk
delivered twice counts once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.sources.tables import spread

KINDS = ("prose", "toc", "form", "listing", "junk")
TINY_WORDS, FIT_ROWS = 25, 6000

# Fixed value: frequent English words.
COMMON = frozenset("the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no out up into than them only some could these two may then do first any my now such like our over".split())

_WORD = re.compile(r"[^\W_]+")
_TOC = re.compile(r"(?:\.{3,}|(?:\. ){3,}|…|·{2,}|\s{3,}|\t|\||_{3,}|-{3,})[\s.]*\|?\s*\d{1,4}\s*\|?\s*$")
_FORM = re.compile(r"_{3,}|☐|□|❑|\[ ?\]|\( {2,}\)|\.{6,}\s*$|^[^.!?]{3,60}:\s*$")
_ROWS = re.compile(r"\t|\|.*\||;.*;|\S {2,}\S.* {2,}\S")
_SENTENCE_END = re.compile(r"[a-z0-9)][.!?](?=\s|$)")
_BULLET = re.compile(r"^\s*(?:[-•*·–▪]|\d{1,3}[.)]|[a-z][.)])\s")

MEASURES = (
    "words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "lines_ending_in_punctuation", "common_words",
    "toc_lines", "form_lines", "row_lines", "bullet_lines", "mean_line_words", "longest_token", "distinct_words", "top_word_share",
    "odd_tokens", "code_ratio", "vowel_ratio", "sentence_share", "space_ratio", "commas_per_word", "sentence_ends_per_word",
)


_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
_BLANK = bytes(i for i in range(128) if chr(i).isspace())


def _kinds_of_characters(text: str) -> tuple[int, int, int, int]:
    """How many are digits, letters, capitals and blanks; by bytes where the text is plain."""
    if not text.isascii():
        return tuple(sum(map(f, text)) for f in (str.isdigit, str.isalpha, str.isupper, str.isspace))
    b = text.encode()
    digits, upper, lower, blank = (len(b) - len(b.translate(None, x)) for x in (_DIGITS, _UPPER, _LOWER, _BLANK))
    return digits, upper + lower, upper, blank


def _is_odd(token: str) -> bool:
    """Whether a token is neither a word nor a figure, marks around and inside them aside."""
    if token.isalpha():
        return False
    core = token.strip(".,;:!?()\"'$%")
    return not core.isalpha() and not core.replace("-", "").replace("/", "").replace("'", "").isalpha() and not core.replace(",", "").replace(".", "").isdigit()


def _is_contents(line: str) -> bool:
    end = line.rstrip()
    if end.endswith("|"):
        end = end[:-1].rstrip()
    return end[-1:].isdigit() and bool(_TOC.search(line))  # most lines end otherwise, and are told by that


def _is_form(line: str) -> bool:
    some = "___" in line or "(" in line or "[" in line or "......" in line or "☐" in line or "□" in line or "❑" in line or line.rstrip().endswith(":")
    return some and bool(_FORM.search(line))


def _is_row(line: str) -> bool:
    return ("  " in line or ";" in line or "|" in line or "\t" in line) and bool(_ROWS.search(line))


def measures(text: str | None) -> tuple[float, ...]:
    """The measures of a text, in the order of ``MEASURES``; shares of lines are weighted by their length where kinds of lines mix."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    low = text.lower()
    words = _WORD.findall(low)
    n, tokens, size = len(words), text.split(), max(1, len(text))
    if not n and not tokens:
        return (0.0,) * len(MEASURES)
    held = sum(map(len, lines)) or 1
    digits, alpha, upper, spaces = _kinds_of_characters(text)
    toc = form = rows = bullets = sentences = 0
    for x in lines:
        if _is_contents(x):
            toc += len(x)
        elif _is_form(x):
            form += len(x)
        elif _BULLET.match(x):
            bullets += len(x)
        elif _is_row(x):
            rows += len(x)
        elif x.count(" ") >= 5:
            sentences += len(x)
    odd = sum(map(_is_odd, tokens))
    counts = Counter(words)
    return (
        float(n), sum(map(len, words)) / max(1, n), (size - digits - alpha - spaces) / size, digits / size, upper / max(1, alpha),
        sum(x.rstrip()[-1:] in ".!?" for x in lines) / max(1, len(lines)), sum(counts[w] for w in COMMON & counts.keys()) / max(1, n),
        toc / held, form / held, rows / held, bullets / held, len(tokens) / max(1, len(lines)), float(max(map(len, tokens))),
        len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n), odd / len(tokens),
        sum(text.count(c) for c in "{}<>=#\\^~") / size, sum(low.count(c) for c in "aeiou") / max(1, alpha), sentences / held, spaces / size,
        text.count(",") / max(1, n), len(_SENTENCE_END.findall(text)) / max(1, n),
    )


#: Measures that the rules take a kind from, hidden in one fitted text of so many.
TELLING = {1: ("toc_lines",), 2: ("form_lines",), 3: ("row_lines", "bullet_lines", "commas_per_word"), 4: ("longest_token", "symbol_ratio", "code_ratio")}
HIDE_EVERY = 4


def weak_label(m: tuple[float, ...]) -> int:
    """The kind that rules are sure of, as a place in ``KINDS``; -1 if they aren't."""
    v = dict(zip(MEASURES, m))
    if v["words"] and v["longest_token"] < 60:
        for kind, x in ((1, v["toc_lines"]), (2, v["form_lines"]), (3, v["row_lines"] + v["bullet_lines"])):
            if x >= 0.8 and v["code_ratio"] < 0.02:
                return kind
    if v["longest_token"] >= 100 or v["symbol_ratio"] > 0.3 or v["code_ratio"] > 0.04 or v["words"] >= 30 and v["distinct_words"] < 0.15 and v["common_words"] < 0.1 or v["words"] >= 8 and v["vowel_ratio"] < 0.15:
        return 4
    # entries of a list set in one line
    if v["commas_per_word"] >= 0.12 and v["words"] >= 15 and v["sentence_ends_per_word"] < 0.02 and v["common_words"] < 0.13:
        return 3
    if v["toc_lines"] + v["form_lines"] + v["row_lines"] + v["bullet_lines"] <= 0.3 and v["common_words"] >= 0.15 and v["code_ratio"] < 0.01 and v["odd_tokens"] < 0.25:
        return 0
    return -1


class Boosted:
    """Gradient-boosted trees for several classes, on binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.prior, self.temperature, self.offset = np.zeros(0), 1.0, np.zeros(1)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, k: int) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # rare kinds lie beyond most quantiles: borders between the kinds' means as well
        means = [x[y == c].mean(0) for c in range(k) if (y == c).any()]
        self.edges = [np.unique(np.concatenate([e, [(a[j] + b[j]) / 2 for a in means for b in means]])) for j, e in enumerate(self.edges)]
        b = self._bin(x)
        share = np.bincount(y, minlength=k) + 1.0
        self.prior = np.log(share / share.sum())
        score, hot = np.tile(self.prior, (len(x), 1)), np.eye(k)[y]
        # each kind weighs alike in sum, up to a bound
        weight = np.minimum(len(y) / (k * share), 20.0)[y]
        for _ in range(self.rounds):
            p = _softmax(score)
            row = []
            for c in range(k):
                g, h = weight * (hot[:, c] - p[:, c]), weight * p[:, c] * (1 - p[:, c]) + 1e-6
                tree = self._tree(b, g, h)
                score[:, c] += self.rate * self._leaf(tree, b)
                row.append(tree)
            self.trees.append(row)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = (1 << self.depth) - 1
        feature, cut, value = np.zeros(size, np.int64), np.full(size, 1 << 30), np.zeros(1 << self.depth)
        node = np.zeros(len(b), np.int64)
        for level in range(self.depth):
            base, wide = (1 << level) - 1, 1 << level
            best = np.full(wide, 1e-9)
            for j in range(b.shape[1]):
                m = len(self.edges[j]) + 1
                at = (node - base) * m + b[:, j]
                gs, hs = (np.bincount(at, v, wide * m).reshape(wide, m).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                top = gain[:, :-1].argmax(1) if m > 1 else np.zeros(wide, int)
                score = gain[np.arange(wide), top]
                better = score > best if m > 1 else np.zeros(wide, bool)
                feature[base : base + wide][better], cut[base : base + wide][better], best[better] = j, top[better], score[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - size
        gs, hs = np.bincount(leaf, g, 1 << self.depth), np.bincount(leaf, h, 1 << self.depth)
        value[:] = np.clip(gs / (hs + 1), -4, 4)
        return feature, cut, value

    def _leaf(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.tile(self.prior, (len(x), 1))
        for row in self.trees:
            for c, tree in enumerate(row):
                out[:, c] += self.rate * self._leaf(tree, b)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.02, steps: int = 300) -> Boosted:
        """The temperature, and the offset of each kind, under which the holdout is most likely; offsets are held back."""
        s, hot = self.scores(x), np.eye(len(self.prior))[y]
        weight = (1 / np.bincount(y, minlength=len(self.prior))[y])[:, None]
        best = np.inf
        for t in np.geomspace(0.25, 8, 41):
            offset = np.zeros(len(self.prior))
            for _ in range(steps):
                offset -= 0.5 * ((weight * (_softmax(s / t + offset) - hot)).sum(0) / weight.sum() + 2 * ridge * offset)
            loss = -(weight[:, 0] * np.log(_softmax(s / t + offset)[np.arange(len(y)), y] + 1e-12)).sum() / weight.sum() + ridge * (offset**2).sum()
            if loss < best:
                best, self.temperature, self.offset = loss, float(t), offset
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.scores(x) / self.temperature + self.offset)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Texts whose kind was checked by hand, for calibration only.
HOLDOUT: list[tuple[str, str]] = [
    ("prose", "The committee met twice in spring. It agreed that the fees for glasses should be paid in full, but only when a doctor had asked for them, and that members must be told by letter."),
    ("prose", "When a claim is refused, the member may ask for a second opinion within thirty days.\n\nThe second reader has not seen the case before and decides alone."),
    ("prose", "Visits for hearing tests are free of charge in the first year.\nYou can choose from the following:\n- clinics in town\n- clinics at the hospital\nAll of them will send the bill to us, so there is nothing that you have to pay in advance or to send in later."),
    ("prose", "In most cases the dentist sends us a plan before the work begins, and we answer within a week. Name: ________ is printed on the plan by the practice, not by you."),
    ("prose", "An extra\nscan is paid for if the first one could not be read. The practice must keep\nthe first picture, and it must say why the second one was needed by the\nmember or by the surgeon."),
    ("toc", "Contents\nWhat is covered ........ 3\nWhat is not covered ........ 9\nHow to appeal ........ 14\nWords we use ........ 20"),
    ("toc", "1. Glasses and lenses . . . . . . 4\n2. Hearing aids . . . . . . . 7\n3. Walking frames . . . . . 12\n4. Home visits . . . . . . . . 15"),
    ("toc", "Rules for children     5\nRules for students     8\nRules for retired members     11\nRules for travel     16"),
    ("form", "Full name ____________\nDate of birth ____________\nMember number ____________\nSignature ____________"),
    ("form", "[ ] single\n[ ] married\n[ ] retired\nTelephone:\nAddress of the clinic:\n☐ I agree"),
    ("form", "Name of spouse: (      )  print clearly\nAccount number: (      )  print clearly\nSigned on: (      )"),
    ("listing", "A101\tcrown\t$900\t50%\nA102\tbridge\t$1,400\t50%\nA103\tfilling\t$120\t80%"),
    ("listing", "- glasses, plain\n- glasses, tinted\n- contact lenses\n- hearing aids\n- walking frames\n- insulin pumps"),
    ("listing", "| code | service | fee |\n| A1 | visit | 40 |\n| A2 | scan | 310 |\n| A3 | test | 25 |"),
    ("listing", "eye exam;B2001;$80;2024\nhearing test;B2002;$95;2024\nlab panel;B2003;$140;2025"),
    ("listing", "A7 plain lenses, A8 tinted lenses, A9 hearing aid for the left ear, B1 walking frame, B2 insulin pump, B3 home visit, B4 travel vaccine, B5 eye exam, B6 skin test"),
    ("junk", "xkcd vrtn qwfp zxcv bnmk lkjh grtp wqrt plmk nbvc xzsd fghj klpr twqs dfgr vbnt mkjh grfd"),
    ("junk", "Zk81Qa0dLmRr7yTTpP2uVxW93bNc0OeHh5sGjKqLwErTyUiOpAsDfGhJkLzXcVbNm1234567890QwErTyUiOpAsDfGhJkLzXcVbNmZk81Qa0dLmRr7yT"),
    ("junk", "^~ {]%@ $$ ]^%; :k7 <^&> ~| {{;[%@77 [[}~:&@= _=:^@ _\\+:] <_+^ *@[#\\] ~~=*}}@> \\<>:+ %|&~[^7 [{ <<+<"),
    ("junk", ".box-1 { margin: 3px; color: #aa00ff; float: left; }\n.box-2 { margin: 9px; color: #00ffaa; float: left; }\n.box-3 { padding: 2px; }"),
    ("junk", "null none null none null none null none null none null none null none null none null none null none null none null none null none null none null none null none"),
]


def fit_kinds(texts: list[str]) -> Boosted:
    """Trees fitted on the texts that rules can label, calibrated on the holdout."""
    return fit_measures([measures(t) for t in texts])


def fit_measures(m: list[tuple[float, ...]]) -> Boosted:
    """The same from the texts' measures."""
    y = [weak_label(x) for x in m]
    rows = [(a, b) for a, b in zip(m, y) if b >= 0]
    # where a sample lacks a kind, plain specimens of it stand in
    for k in range(len(KINDS)):
        if sum(b == k for _, b in rows) < 8:
            rows += [(measures(t), k) for t in _specimens(KINDS[k])]
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    hidden = x[::HIDE_EVERY].copy()
    for k, names in TELLING.items():
        if (y == k).sum() < 50:  # too few to tell what else they have in common
            continue
        hidden[np.ix_(y[::HIDE_EVERY] == k, [MEASURES.index(m) for m in names])] = 0.0
    x, y = np.concatenate([x, hidden]), np.concatenate([y, y[::HIDE_EVERY]])
    hold = np.array([measures(t) for _, t in HOLDOUT]), np.array([KINDS.index(k) for k, _ in HOLDOUT])
    return Boosted().fit(x, y, len(KINDS)).calibrate(*hold)


def _specimens(kind: str) -> list[str]:
    """Ten plain texts of a kind, by rule."""
    words = [w for w in sorted(COMMON) if len(w) > 2]
    pick = lambda i, n: " ".join(words[(i * 7 + j * 3) % len(words)] for j in range(n))
    if kind == "prose":
        return [". ".join(pick(i + s, 14).capitalize() for s in range(2 + i)) + "." for i in range(10)]
    if kind == "junk":
        return ["x9Qz" * (30 + i) if i % 2 else "none null " * (25 + i) for i in range(10)]
    line = {"toc": "{} ........ {}", "form": "{} ________ ", "listing": "{}\tA{}\t$ 5"}[kind]
    return ["\n".join(line.format(pick(i + j, 3), j + i) for j in range(5 + i)) for i in range(10)]


def _once(records: DataFrame) -> DataFrame:
    return records.where("chunk_id is not null").select("chunk_id", "document_id", "text")


def _model(records: DataFrame, fit_rows: int) -> Boosted:
    rows = _once(records)
    share = min(1.0, 2 * fit_rows / max(1, records.count()))
    place = F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_000))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"m": pd.Series([list(measures(t)) for t in b.text], dtype=object), "place": b.place, "chunk_id": b.chunk_id})

    part = rows.where(place < int(1_000_000 * share)).where("text is not null").select("chunk_id", place.alias("place"), "text")
    held = part.mapInPandas(go, "m array<double>, place bigint, chunk_id string").orderBy("place", "chunk_id", "m").limit(fit_rows)
    return fit_measures([tuple(r.m) for r in held.collect()])


def chunk_kinds(records: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(chunk_id, document_id, words, kind, probability): prose and tiny included."""
    sent = records.sparkSession.sparkContext.broadcast(_model(records, fit_rows))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m = np.array([measures(t) for t in b.text])
            p = sent.value.probabilities(m)
            best, words = p.argmax(1), m[:, 0].astype(int)
            kind = [k if k != "prose" and w else "tiny" if w < TINY_WORDS and (k == "prose" or not w) else k for k, w in ((KINDS[i], w) for i, w in zip(best, words))]
            kind = ["tiny" if t is None or not t.strip() else k for k, t in zip(kind, b.text)]
            yield frame(zip(b.chunk_id, b.document_id, words.tolist(), kind, p.max(1).tolist()), ["chunk_id", "document_id", "words", "kind", "probability"])

    return _once(records).mapInPandas(go, "chunk_id string, document_id string, words int, kind string, probability double").dropDuplicates(["chunk_id"])


def text_measures(records: DataFrame) -> DataFrame:
    """(chunk_id, the measures): each chunk once."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = np.array([measures(t) for t in b.text]).reshape(len(b), len(MEASURES))
            yield pd.DataFrame({"chunk_id": b.chunk_id} | {k: np.round(m[:, i], 6) for i, k in enumerate(MEASURES)})

    schema = "chunk_id string, " + ", ".join(f"{k} double" for k in MEASURES)
    return _once(records).select("chunk_id", "text").mapInPandas(go, schema).dropDuplicates(["chunk_id"])


def document_measures(kinds: DataFrame) -> DataFrame:
    """(document_id, median_words, tiny, toc, form) as document_stats should have them."""
    n = lambda k: F.sum((F.col("kind") == k).cast("int")).cast("int").alias(k)
    return kinds.where("document_id is not null").groupBy("document_id").agg(F.percentile("words", F.lit(0.5)).alias("median_words"), n("tiny"), n("toc"), n("form"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_kinds(spread(spark.read.parquet(f"{sf_dir}/chunk_records.parquet"))).where("kind <> 'prose'").select("chunk_id", "kind")


def p6_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_measures(spread(spark.read.parquet(f"{sf_dir}/chunk_records.parquet")))


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_measures(chunk_kinds(spread(spark.read.parquet(f"{sf_dir}/chunk_records.parquet"))))
