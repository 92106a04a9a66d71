"""Problem 9: one consistent form for text whose characters only look alike.

Order of the steps: characters without width go, other spaces become plain
ones, full-width and other compatibility forms (ligatures, letters in circles
or of mathematical alphabets, half-width kana, Roman numerals of one
character) become plain, separate accents are composed, and last each word
that holds look-alike letters is read through a lattice of them. The lattice
search is Viterbi over character bigrams with a price for every change of
script, inside the word and against the words around it, so a word comes out
in the one script that explains it best.

Defined results: null text stays null and has no forms; empty text stays
empty; text that rightly is in another script is returned unchanged.
Superscripts, subscripts, fractions and typographic signs keep their form, as
their plain one means something else. Compatibility forms other than
full-width ones change the text but aren't among the forms reported.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.functions.frames import frame
from codexa.sources.tables import spread

# Letters of other scripts that are drawn like a Latin letter.
LOOK_ALIKE = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i",
    "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k",
    "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ϲ": "C", "ϲ": "c", "Ϳ": "J", "ϳ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮓ": "Z", "Ꮢ": "R", "Ꮩ": "V",
    "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q", "յ": "j", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
}
ZERO_WIDTH = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
SPACES = "   -   　"
CJK = "⺀-⿟、-ヿ㄀-鿿가-힯豈-﫿"
JOINING = "؀-ࣿऀ-෿က-႟ក-៿ﭐ-﷿ﹰ-﻾"
EMOJI = "←-⇿⌀-⏿☀-➿⬀-⯿️\U0001f000-\U0001faff"
FORMS = ("full_width", "combining", "zero_width", "space", "look_alike")

_ZERO = re.compile(f"[{ZERO_WIDTH}]")
_SPACE = re.compile(f"[{SPACES}]")
_WIDE = re.compile("[！-～￠￡￥]")
_MARKS = re.compile("[^\\W\\d_][̀-ͯ]+")
_IS_CJK, _IS_JOINING, _IS_EMOJI = (re.compile(f"[{x}]") for x in (CJK, JOINING, EMOJI))
_FOREIGN = re.compile(f"[{''.join(LOOK_ALIKE)}]")
_WORD = re.compile("[^\\W\\d_]+")
#: Kinds of compatibility forms that have a plain form of the same meaning, and ranges that are text of their own script.
PLAIN_KINDS = ("<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<circle>", "<narrow>", "<square>", "<compat>")
_OWN = ((0x0E00, 0x0FFF), (0x2E80, 0x2FDF), (0x3130, 0x318F), (0xFF01, 0xFF5E), (0xFFA0, 0xFFDC))


def _compatibility() -> str:
    """The characters of those kinds whose plain form holds letters or digits, by the Unicode database."""
    out = []
    for o in (*range(0xA0, 0x10000), *range(0x1D400, 0x1D800), *range(0x1EE00, 0x1EF00), *range(0x1F100, 0x1F150)):
        kind = unicodedata.decomposition(chr(o)).partition(" ")[0]
        if kind in PLAIN_KINDS and not any(a <= o <= b for a, b in _OWN):
            if kind == "<narrow>" or any(map(str.isalnum, unicodedata.normalize("NFKC", chr(o)))):
                out.append(chr(o))
    return "".join(out)


_COMPATIBLE = _compatibility()
# characters of the basic plane and others in classes of their own, as one class of both is searched much more slowly
_BASIC = re.escape("".join(x for x in _COMPATIBLE if ord(x) < 0x10000))
_BEYOND = re.compile(f"[{''.join(x for x in _COMPATIBLE if ord(x) >= 0x10000)}]+")
_COMPAT = re.compile(f"[{_BASIC}]+(?!\\ufe0f)")
_ASTRAL = re.compile("[\U0001d400-\U0001efff\U0001f100-\U0001f14f]")
#: What text must hold before any of the steps can change it, characters beyond the basic plane aside.
SUSPECT = f"[{ZERO_WIDTH}{SPACES}！-～￠￡￥̀-ͯ{''.join(LOOK_ALIKE)}{_BASIC}]"
_SUSPECT = re.compile(SUSPECT)
_WIDE_MAP = {0xFF01 + i: 0x21 + i for i in range(94)} | {0xFFE0: 0xA2, 0xFFE1: 0xA3, 0xFFE5: 0xA5}


def script(ch: str) -> str:
    """The script of a letter, as far as look-alikes need it told apart."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "L"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530:
        return "C"
    if 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0:
        return "H"
    return "A" if 0x530 <= o < 0x590 else "O"


class Bigrams:
    """Character bigrams of each script, mixed with an even chance for every letter, so that scores don't hang on the corpus size."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = dict(counts or {})
        self.first = Counter()
        for k, n in self.counts.items():
            self.first[k[0]] += n

    @staticmethod
    def tally(words: Iterable[tuple[str, int]]) -> Counter[str]:
        """Bigrams of (word, count) as far as the words lie in one script each."""
        c: Counter[str] = Counter()
        for w, n in words:
            kinds = {script(x) for x in w}
            if len(kinds) == 1 and kinds != {"O"}:  # scripts without look-alikes never are in a path
                w = f"^{w.lower()}$"
                for i in range(len(w) - 1):
                    c[w[i : i + 2]] += n
        return c

    @classmethod
    def fit(cls, words: Iterable[str]) -> Bigrams:
        """Counts from words that lie in one script each."""
        return cls(cls.tally((w, 1) for w in words))

    def score(self, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        n = self.first.get(a, 0)
        return math.log(0.9 * self.counts.get(a + b, 0) / n + 0.1 / 30) if n else math.log(1 / 30)

    #: Price of a change of script inside one word, of one against the words on either side, and of giving up a letter for its look-alike.
    SWITCH, APART, REPLACE = 12.0, 24.0, 1.0

    def read(self, word: str, around: str | None = None) -> tuple[str, float]:
        """The cheapest path through the word's look-alike lattice; ``around`` is the script of the words about it."""
        paths: dict[str, tuple[float, str]] = {}
        for i, ch in enumerate(word):
            nxt: dict[str, tuple[float, str]] = {}
            for alt in {ch, LOOK_ALIKE.get(ch, ch)}:
                cost = self.REPLACE * (alt != ch)
                if i == 0:
                    nxt[alt] = (self.score("^", alt) - cost - self.APART * (around is not None and script(alt) != around), alt)
                else:
                    nxt[alt] = max((s + self.score(p[-1], alt) - cost - self.SWITCH * (script(p[-1]) != script(alt)), p + alt) for s, p in paths.values())
            paths = nxt
        s, best = max((s + self.score(p[-1], "$"), p) for s, p in paths.values())
        return best, s


def _context(words: list[re.Match], i: int) -> str:
    """Script of the nearest words that aren't made of look-alikes alone; Latin if there is none."""
    votes = Counter()
    for step in (-1, 1):
        j, seen = i + step, 0
        while 0 <= j < len(words) and seen < 2:
            kinds = {script(x) for x in words[j].group() if x not in LOOK_ALIKE}
            if len(kinds) == 1:
                votes[kinds.pop()] += 1
                seen += 1
            j += step
    return "L" if not votes or votes["L"] >= max(votes.values()) else votes.most_common(1)[0][0]


def _plain_letters(text: str, model: Bigrams) -> tuple[str, bool]:
    words = list(_WORD.finditer(text))
    out, at, hit = [], 0, False
    for i, m in enumerate(words):
        w = m.group()
        if not _FOREIGN.search(w):
            continue
        kinds = {script(x) for x in w}
        if "L" in kinds:
            new, _ = model.read(w)
            if len({script(x) for x in new}) > 1:  # no path in one script: single symbols such as a Greek letter stay
                continue
        elif len(kinds) == 1 and all(x in LOOK_ALIKE for x in w):
            if len(w) == 1 and (kinds == {"G"} or not w.islower() and not w.isupper()):
                continue
            new, _ = model.read(w, _context(words, i))
            if {script(x) for x in new} != {"L"}:
                continue
        else:
            continue
        if new != w:
            out += [text[at : m.start()], new]
            at, hit = m.end(), True
    return ("".join([*out, text[at:]]), True) if hit else (text, False)


def consistent(text: str | None, model: Bigrams | None = None) -> tuple[str | None, list[str]]:
    """The text in its consistent form, and the forms that were found in it."""
    if not text or text.isascii() or not _SUSPECT.search(text) and not _ASTRAL.search(text):
        return text, []
    found = []

    def zero(m: re.Match) -> str:
        a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if m.group() == "‍" and _IS_EMOJI.match(a) and _IS_EMOJI.match(b) or m.group() in "‌‍" and _IS_JOINING.match(a):
            return m.group()
        found.append("zero_width")
        return ""

    text = _ZERO.sub(zero, text)

    def space(m: re.Match) -> str:
        if m.group() == "　" and _IS_CJK.match(text[m.start() - 1 : m.start()]) and _IS_CJK.match(text[m.end() : m.end() + 1]):
            return m.group()
        found.append("space")
        return " "

    text = _SPACE.sub(space, text)

    def wide(m: re.Match) -> str:
        ch = m.group()
        if not ch.translate(_WIDE_MAP).isalnum() and (_IS_CJK.match(text[m.start() - 1 : m.start()]) or _IS_CJK.match(text[m.end() : m.end() + 1])):
            return ch
        found.append("full_width")
        return ch.translate(_WIDE_MAP)

    text = _WIDE.sub(wide, text)
    text = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if _ASTRAL.search(text):
        text = _BEYOND.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)

    def marks(m: re.Match) -> str:
        new = unicodedata.normalize("NFC", m.group())
        if len(new) < len(m.group()):
            found.append("combining")
        return new

    text = _MARKS.sub(marks, text)
    text, hit = _plain_letters(text, model or Bigrams())
    if hit:
        found.append("look_alike")
    return text, [x for x in FORMS if x in found]


def fit_model(texts: DataFrame, column: str = "text") -> Bigrams:
    """Bigrams of all words of all texts that lie in one script each; only which path wins in a mixed word depends on them."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        total: Counter[str] = Counter()
        for b in batches:
            for t in b.t:
                words.update(_WORD.findall(t.lower()))
            if len(words) > 500_000:
                total.update(Bigrams.tally(words.items()))
                words.clear()
        total.update(Bigrams.tally(words.items()))
        yield frame(total.items(), ["pair", "n"])

    rows = texts.select(F.col(column).alias("t")).where(F.col("t").isNotNull())
    counts = rows.mapInPandas(go, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return Bigrams({r.pair: r.n for r in counts.collect()})  # as many as there are pairs of letters within a script


def _beyond_ascii(column: str) -> Column:
    """Plain ASCII can't change, so the JVM keeps it back from Python; much cheaper than a pattern."""
    return F.octet_length(column) > F.length(column)


def with_consistent(df: DataFrame, column: str = "text", text_out: str = "consistent_text", forms_out: str = "forms", model: Bigrams | None = None) -> DataFrame:
    """Adds the consistent text and the array of forms found in it.

    Null text gives null and an empty array. Columns of the same names are replaced.
    """
    model = fit_model(df, column) if model is None else model

    @F.pandas_udf("t string, f array<string>")
    def run(s: pd.Series) -> pd.DataFrame:
        pairs = [consistent(x, model) for x in s]
        return pd.DataFrame({"t": [p[0] for p in pairs], "f": [p[1] for p in pairs]})

    suspect = _beyond_ascii(column)
    df = df.withColumn("__c", F.when(suspect, run(F.when(suspect, F.col(column)))))
    return df.withColumns({text_out: F.when(suspect, F.col("__c.t")).otherwise(F.col(column)), forms_out: F.coalesce(F.col("__c.f"), F.array().cast("array<string>"))}).drop("__c")


def found_forms(documents: DataFrame, model: Bigrams | None = None) -> DataFrame:
    """(doc_id, form): one row per document and form found in its text."""
    model = fit_model(documents) if model is None else model
    docs = documents.where(_beyond_ascii("text")).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, f) for i, t in zip(b.doc_id, b.text) for f in consistent(t, model)[1]]
            yield frame(rows, ["doc_id", "form"]).astype({"doc_id": "int64"})

    return docs.where(F.col("doc_id").isNotNull()).mapInPandas(run, "doc_id bigint, form string").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_forms(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def p9_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_consistent(docs.select("doc_id", "text")).select("doc_id", F.col("consistent_text").alias("text"), F.array_join("forms", ",").alias("forms"))
