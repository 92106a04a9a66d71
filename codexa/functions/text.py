"""Text functions as column expressions, all of them inside the JVM unless said otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The word forms and stop words that lexical search uses.
WORDS_HYPHEN = "[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
WORDS_ALNUM = "[a-z0-9]+"
WORDS_NUMBERS = "[a-z0-9]+(?:[.,][0-9]+)*%?"
WORDS_CONTENT = "[a-z0-9$%.-]+"
STOP_WORDS = "a an and are as at be by for from how in is it of on or that the this to was what when where which who will with".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once; an expression that is only written once is still inlined at each use."""
    return F.transform(F.array(value), use)[0]


def found(text: Column | str, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; null text gives null."""
    return F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(group))


def tokens_hyphen(text: Column | str) -> Column:
    return F.transform(found(text, WORDS_HYPHEN), F.lower)


def tokens_alnum(text: Column | str) -> Column:
    return found(F.lower(_c(text)), WORDS_ALNUM)


def tokens_numbers(text: Column | str) -> Column:
    return found(F.lower(_c(text)), WORDS_NUMBERS)


def tokens_content(text: Column | str, stop: list[str] = STOP_WORDS) -> Column:
    """Tokens with amounts and percentages, without stop words and pure punctuation."""
    return F.filter(found(F.lower(_c(text)), WORDS_CONTENT), lambda x: ~x.isin(stop) & x.rlike("[a-z0-9]"))


def long_words(text: Column | str, stop: list[str] = STOP_WORDS, least: int = 4) -> Column:
    """Distinct words of some length, in the order of their first place."""
    return F.array_distinct(F.filter(found(F.lower(_c(text)), f"[a-z_0-9]{{{least},}}"), lambda x: ~x.isin(stop)))


def expanded(tokens: Column | str, synonyms: dict[str, list[str]]) -> Column:
    """Tokens, each followed by its synonyms."""
    m = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(_c(tokens), lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(m, t), F.array().cast("array<string>")))))


def squeezed(text: Column | str) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "")


@F.pandas_udf(T.StringType())
def nfkc_words(s: pd.Series) -> pd.Series:
    """Compatibility form, case folded, other characters as single spaces; Spark has no normaliser of its own."""
    return s.map(lambda x: None if x is None else re.sub(r"\W+", " ", unicodedata.normalize("NFKC", x).casefold()).strip())


def masked_line(text: Column | str) -> Column:
    """A line in lower case with # for each number."""
    return F.regexp_replace(F.lower(F.trim(_c(text))), "[0-9]+", "#")


def plain_number(text: Column | str) -> Column:
    """A numeric answer without percent sign, separators and trailing zeros."""
    x = F.regexp_replace(F.lower(_c(text)), "[%,\\s]", "")
    return F.regexp_replace(x, "(\\.[0-9]*?)0+$|\\.$", "$1")


def clean_lines(text: Column | str) -> Column:
    """Single spaces, no blank lines."""
    lines = F.transform(F.split(_c(text), "\n", -1), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def plain_quotes(text: Column | str) -> Column:
    return F.regexp_replace(F.translate(_c(text), "‘’“”", "''\"\""), "\\s+", " ")


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    from html import unescape

    return s.map(unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _to_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def unescaped(text: Column | str) -> Column:
    """Entities as characters; only texts that hold one go through Python."""
    t = _c(text)
    some = F.coalesce(t.rlike("&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"), F.lit(False))
    return F.when(some, _unescaped(F.when(some, t))).otherwise(t)


def no_markup(text: Column | str) -> Column:
    """Without tags, entities, Markdown marks and runs of dashes."""
    x = unescaped(F.regexp_replace(_c(text), "<[^>]+>", " "))
    x = F.regexp_replace(x, "[*_`#>|]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "-{2,}", " "), "\\s+", " "))


def slug(text: Column | str, most: int = 90) -> Column:
    """Letters and digits joined by dashes, accents left out; only texts beyond ASCII go through Python."""
    t = _c(text)
    beyond = F.coalesce(F.octet_length(t) > F.length(t), F.lit(False))
    plain = F.when(beyond, _to_ascii(F.when(beyond, t))).otherwise(t)
    x = F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(x, 1, most)


def last_year(text: Column | str) -> Column:
    """The last year 20xx in a text, or null."""
    return F.try_element_at(found(text, "20[0-9]{2}"), F.lit(-1)).cast("int")


def billing_codes(text: Column | str) -> Column:
    """Distinct codes of a letter and four digits, in order."""
    return F.array_distinct(F.transform(found(text, "\\b([A-Za-z][0-9]{4})\\b", 1), F.upper))


def numbers_in(text: Column | str) -> Column:
    """Amounts, percentages and figures with a letter, without separators, in order."""
    hits = found(F.lower(_c(text)), "\\$[0-9][0-9,]*(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?%|\\b[0-9]+[a-z]\\b")
    return F.array_distinct(F.transform(hits, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def names_in(text: Column | str) -> Column:
    """Acronyms and words with inner capitals, distinct, in order."""
    return F.array_distinct(found(text, "\\b(?:[A-Z]{2,}[0-9]*|[A-Z][a-z]+[A-Z][A-Za-z]+)\\b"))


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def has_card(text: Column | str) -> Column:
    """Whether a text holds a payment card: 13 to 19 digits, more than one kind of digit, right by the Luhn test."""
    digits = F.transform(found(text, "\\b[0-9](?:[ -]?[0-9]){12,18}\\b"), lambda x: F.regexp_replace(x, "[ -]", ""))
    return F.exists(digits, lambda x: _luhn(x) & (F.size(F.array_distinct(F.split(x, ""))) > 1))


def seeded(seed: int, value: Column | str) -> Column:
    """A number from 0 to 2**60 - 1 that follows from a seed and a value, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), _c(value).cast("string"))), 1, 15), 16, 10).cast("bigint")


def short_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(_c(text), 256), 1, 12))


def container_check_digit(code: Column | str) -> Column:
    """Check digit of a freight container's first ten characters; null for other texts."""
    letters = "0123456789A?BCDEFGHIJK?LMNOPQRSTU?VWXYZ"
    at = F.sequence(F.lit(0), F.lit(9))
    weights = F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + (F.position(F.substr(_c(code), i + 1, F.lit(1)), F.lit(letters)) - 1) * F.pow(F.lit(2), i).cast("long"))
    return F.when(_c(code).rlike("^[A-Z]{4}[0-9]{6}"), weights % 11 % 10)


def lenient_number(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), "[^0-9.+-]", "").try_cast("double")


def lenient_date(text: Column | str) -> Column:
    """ISO dates, or day/month/year."""
    t = F.trim(_c(text))
    dmy = F.regexp_extract(t, "^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", 3)
    built = F.concat_ws("-", dmy, F.lpad(F.regexp_extract(t, "^([0-9]{1,2})/([0-9]{1,2})/", 2), 2, "0"), F.lpad(F.regexp_extract(t, "^([0-9]{1,2})/", 1), 2, "0"))
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date")).when(dmy != "", built.try_cast("date"))


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(_c(text)) / 4)


def template(pattern: str, **values: Column) -> Column:
    """A text with {name} replaced; missing values show as a question mark."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)\}", pattern):
        out += [F.lit(pattern[at : m.start()]), F.coalesce(values[m.group(1)].cast("string"), F.lit("?")) if m.group(1) in values else F.lit("?")]
        at = m.end()
    return F.concat(*out, F.lit(pattern[at:]))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where lengths differ or a norm is 0."""
    a, b = _c(a), _c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def logistic(x: Column, centre: float, scale: float) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / scale))


def confidence_band(p: Column) -> Column:
    return F.when(p >= 0.85, "high").when(p >= 0.65, "medium").otherwise("low")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks; order matters, so no set operation can say it."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])
