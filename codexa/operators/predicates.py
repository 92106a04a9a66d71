"""Predicates and projections over chunks, documents and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.functions import text as X

# What counts as contents, form fields and short text.
TOC = r"(?m)\.{5,}\s*[0-9]+|\s{2,}[0-9]+\s*$"
FORM = r"(?im)_{4,}|☐|□|\[\s\]|(?:signature|date of birth|member id|ssn)\s*:?\s*$"
TINY_WORDS, TOC_LEAST, FORM_LEAST = 25, 3, 2


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_f1(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Overlap of two texts' token counts as F1; null texts count as empty, both empty give no row."""
    side = lambda c, n: df.select(key, F.explode(X.tokens_alnum(c)).alias("t")).groupBy(key, "t").agg(F.count("*").alias(n))
    both = side(a, "na").join(side(b, "nb"), [key, "t"], "full_outer").groupBy(key).agg(F.sum(F.least(F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)))).alias("o"), F.sum("na").alias("x"), F.sum("nb").alias("y"))
    return both.where("x IS NOT NULL AND y IS NOT NULL").select(key, F.round(2.0 * F.col("o") / (F.col("x") + F.col("y")), 6).alias("f1"))


def contains_words(text: Column | str, phrase: Column | str) -> Column:
    """Whether the phrase's words follow one another in the text, whatever stands between them but letters."""
    norm = lambda x: F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", " "))
    return F.concat(F.lit(" "), norm(text), F.lit(" ")).contains(F.concat(F.lit(" "), norm(phrase), F.lit(" ")))


def is_toc(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(TOC)) >= TOC_LEAST


def is_form(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(FORM)) >= FORM_LEAST


def is_tiny(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(r"(?U)\w+")) < TINY_WORDS


def toc_reason(text: Column | str) -> Column:
    """Why a chunk looks like contents: its heading, or the layout of at least four lines."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    leaders = F.size(F.filter(lines, lambda x: x.rlike(r"\.{3,}|(?:\. ){3,}")))
    entries = F.size(F.filter(lines, lambda x: x.rlike(r"[0-9]+\s*\|?$")))
    heading = F.lower(F.try_element_at(lines, F.lit(1))).rlike("^(?:table of )?contents$")
    return F.when(heading, "toc_heading").when((F.size(lines) >= 4) & ((leaders >= 2) | (entries >= 0.6 * F.size(lines))), "toc_layout")


# Signs of a list of references, and how many of each are too many.
REFERENCES = ((r"\bReferences\b|\bBibliography\b", 0), (r"\[\d+\]", 12), (r"\bet al\.", 3), (r"arXiv preprint|In Proceedings|Proc\.|Conference on|Journal of", 2), (r"\b(?:19|20)\d\d\b", 10))


def looks_like_references(text: Column | str) -> Column:
    """Whether any sign of a reference list comes too often; null text gives null."""
    return reduce(lambda a, b: a | b, [F.regexp_count(_c(text), F.lit(p)) > n for p, n in REFERENCES])


def chunk_problems(chunks: DataFrame, key: str = "chunk_id", text: str = "text", pages: str = "pages", section: str = "section") -> DataFrame:
    """(key, level, problem): errors and warnings of chunks."""
    chunks = chunks.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    n = F.col("__n")
    words = F.regexp_count(F.col(text), F.lit(r"(?U)\w+"))
    found = F.array_compact(F.array(
        F.when(n > 1, "error:duplicate_id"), F.when(F.col(text).isNull() | (F.trim(text) == ""), "error:empty_text"),
        F.when(F.col(pages).isNull() | (F.size(pages) == 0), "error:missing_page_provenance"),
        F.when(F.col(section).isNull(), "warning:unsectioned"), F.when(words < 8, "warning:context_too_short"),
    ))
    one = F.explode(found).alias("p")
    return chunks.select(key, one).select(key, F.substring_index("p", ":", 1).alias("level"), F.substring_index("p", ":", -1).alias("problem"))


def too_similar(a: Column | str, b: Column | str, least: float = 0.7, ratio: float | None = 0.82) -> Column:
    """Whether two questions share most of their words, or most of their characters in order (where a ratio is given; that runs in Python batches)."""
    x, y = F.array_distinct(X.tokens_alnum(a)), F.array_distinct(X.tokens_alnum(b))
    words = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1)) >= least
    if ratio is None:
        return words
    return F.when(words, F.lit(True)).otherwise(X.sequence_ratio(F.lower(_c(a)), F.lower(_c(b))) >= ratio)


def search_text(source: Column | str, section: Column | str, cells: Column) -> Column:
    """A table row as text: its source and section, then "header: value" of each cell that isn't blank."""
    shown = F.filter(F.transform(cells, lambda c: F.when(F.trim(c.value) != "", F.concat(c.header, F.lit(": "), F.trim(c.value)))), lambda x: x.isNotNull())
    return F.concat_ws(". ", _c(source), _c(section), F.concat_ws("; ", shown))
