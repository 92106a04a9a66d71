"""Readers of files that hold documents, chunks, tables and records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """One JSON object a line, blank lines skipped; a bad line fails the read, or goes to ``_corrupt_record`` if not strict."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(StructType([*s.fields]).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)


def read_queries(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(file, line, query, problem): the first of user_input, query and question in each JSON line, with the line's number from 1.

    A line's number is told by its place in the whole file, so a file is read by one task; query batches are small
    files, many of them. Bad lines carry ``problem``; if strict, reading one fails with its file and line.
    """
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "value"))
    t = t.where(F.trim("value") != "").withColumn("j", F.from_json("value", "user_input string, query string, question string"))
    q = F.coalesce("j.user_input", "j.query", "j.question")
    bad = F.when(q.isNull() | (F.trim(q) == ""), "no query")
    t = t.select("file", (F.col("i") + 1).alias("line"), q.alias("query"), bad.alias("problem"))
    if not strict:
        return t
    fail = F.raise_error(F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("problem")))
    return t.withColumn("query", F.when(F.col("problem").isNull(), F.col("query")).otherwise(fail.cast("string")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(document, page, text): page files named page-<n>.md anywhere below a folder."""
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "page-*.md").text(path, wholetext=True).select("value", F.input_file_name().alias("f"))
    return t.select(F.regexp_extract("f", r"([^/]+)/page-\d+\.md$", 1).alias("document"), F.regexp_extract("f", r"page-(\d+)\.md$", 1).cast("int").alias("page"), F.col("value").alias("text")).where(F.trim("text") != "")


def read_numbered_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, body): sections under "## Chunk N"; empty ones are left out."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.explode(F.split("value", r"(?m)^## Chunk (?=\d)")).alias("x"))
    return t.where(F.col("x").rlike(r"^\d+")).select("file", F.regexp_extract("x", r"^(\d+)", 1).cast("int").alias("number"), F.regexp_replace("x", r"^\d+[^\n]*\s*|\s+$", "").alias("body")).where("body <> ''")


def markdown_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, row, cells): pipe rows after a header and a separator; a table ends at the first other line."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).withColumn("pipe", F.trim("line").rlike(r"^\|.*\|$").cast("int"))
    w = Window.partitionBy(key).orderBy("i")
    new = ((F.col("pipe") == 1) & (F.coalesce(F.lag("pipe").over(w), F.lit(0)) == 0)).cast("int")
    t = lines.withColumn("new", new).withColumn("table", F.sum("new").over(w)).where("pipe = 1")
    k = t.withColumn("r", F.row_number().over(Window.partitionBy(key, "table").orderBy("i")))
    has = k.where("r = 2").where(F.trim("line").rlike(r"^\|[\s:|-]+\|$")).select(key, "table")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return k.where("r <> 2").join(has, [key, "table"]).select(key, "table", F.when(F.col("r") == 1, 0).otherwise(F.col("r") - 2).alias("row"), cells.alias("cells"))


def split_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, table, line_no, line): tables in one text, parted by two or more blank lines."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("blank", (F.trim(F.regexp_replace("line", ",", "")) == "").cast("int"))
    w = Window.partitionBy(key).orderBy("line_no")
    gap = ((F.col("blank") == 1) & (F.coalesce(F.lag("blank").over(w), F.lit(0)) == 1) & (F.coalesce(F.lag("blank", 2).over(w), F.lit(0)) == 0)).cast("int")
    return lines.withColumn("g", gap).withColumn("table", F.sum("g").over(w)).where("blank = 0").select(key, "table", "line_no", "line")


def html_tables(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, cells) of the tables in HTML pages; parsing needs Python, so it goes in batches."""
    from collections.abc import Iterator
    from html.parser import HTMLParser

    import pandas as pd

    from codexa.functions.frames import frame

    class Tables(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.table, self.row, self.cell, self.depth = [], 0, None, None, 0

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.depth += 1
                self.table += self.depth == 1
            elif tag == "tr" and self.depth == 1:
                self.row = []
            elif tag in ("td", "th") and self.row is not None and self.depth == 1:
                self.cell = ""

        def handle_data(self, data):
            if self.cell is not None:
                self.cell += data

        def handle_endtag(self, tag):
            if tag == "table":
                self.depth -= 1
            elif tag in ("td", "th") and self.cell is not None:
                self.row.append(" ".join(self.cell.split()))
                self.cell = None
            elif tag == "tr" and self.row is not None and self.depth == 1:
                self.out.append((self.table, self.row))
                self.row = None

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = []
            for k, h in zip(b[key], b[html]):
                p = Tables()
                p.feed(h or "")
                res += [(k, t, n, c) for n, (t, c) in enumerate(p.out)]
            yield frame(res, [key, "table", "row", "cells"])

    return rows.select(key, html).mapInPandas(go, f"{key} {dict(rows.dtypes)[key]}, table int, row int, cells array<string>")


def links(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url): absolute links of pages, without fragments."""
    return rows.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"'](https?://[^\"'#]+)"), F.lit(1))).alias("url")).distinct()


def reachable(pages: DataFrame, start: str, hosts: list[str], depth: int) -> DataFrame:
    """(url, depth): what is reached from a page over (url, html) within some steps and allowed hosts."""
    edges = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)href=[\"'](https?://[^\"'#]+)"), F.lit(1))).alias("to")).where(F.parse_url("to", F.lit("HOST")).isin(hosts)).distinct()
    seen = pages.sparkSession.createDataFrame([(start, 0)], "url string, depth int")
    front = seen
    for k in range(1, depth + 1):
        front = front.select("url").join(edges, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti").select("url", F.lit(k).alias("depth"))
        seen = seen.unionByName(front)
    return seen


def flattened_claims(bundles: DataFrame, resource: str = "resource") -> DataFrame:
    """(claim, patient, provider, date, minutes, lines, paid) of benefit explanations held as JSON text."""
    schema = "id string, patient struct<reference:string>, provider struct<reference:string>, billablePeriod struct<start:timestamp,`end`:timestamp>, item array<struct<productOrService:struct<coding:array<struct<code:string>>>>>, payment struct<amount:struct<value:double>>"
    j = bundles.select(F.from_json(resource, schema).alias("r"))
    minutes = F.greatest(F.lit(0), F.floor((F.unix_timestamp("r.billablePeriod.end") - F.unix_timestamp("r.billablePeriod.start")) / 60))
    code = F.get(F.get("r.item", F.lit(0)).getField("productOrService").getField("coding"), F.lit(0)).getField("code")
    return j.select(F.col("r.id").alias("claim"), F.col("r.patient.reference").alias("patient"), F.col("r.provider.reference").alias("provider"), F.to_date("r.billablePeriod.start").alias("date"), code.alias("code"), minutes.alias("minutes"), F.size("r.item").alias("lines"), F.round("r.payment.amount.value", 2).alias("paid"))


def gold_questions(rows: DataFrame, question: str, relevant: Column) -> tuple[DataFrame, DataFrame]:
    """Questions with a text and at least one relevant source, and those without, with what is wrong."""
    q = F.trim(F.coalesce(question, F.lit(""))) == ""
    problem = F.when(q, "empty question").when(F.coalesce(F.size(relevant), F.lit(0)) < 1, "no relevant source")
    t = rows.withColumn("problem", problem)
    return t.where("problem IS NULL").drop("problem"), t.where("problem IS NOT NULL")


def manifest(rows: DataFrame, key: str, path: str, required: list[str], override: Column | None = None) -> DataFrame:
    """Entries with ``path`` (the override where there is one) and ``problem``: a required value that is missing, or a path that comes twice."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in (key, path, *required)])
    twice = rows.groupBy(F.col(path).alias("_p")).agg(F.count("*").alias("_n")).where("_n > 1")
    t = rows.join(twice, F.col(path) == F.col("_p"), "left")
    to = F.col(path) if override is None else F.coalesce(override, F.col(path))
    return t.select(*rows.columns, to.alias("path"), F.coalesce(missing, F.when(F.col("_n").isNotNull(), "path twice")).alias("problem"))


def feed_entries(rows: DataFrame, xml: str) -> DataFrame:
    """(id, title, authors, categories, published) of feed entries held as XML text."""
    schema = "id string, title string, author array<struct<name:string>>, category array<struct<_term:string>>, published string"
    e = rows.select(F.from_xml(xml, schema).alias("e"))
    names = F.transform("e.author", lambda a: F.trim(a["name"]))
    return e.select("e.id", F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("title"), names.alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"), F.substring("e.published", 1, 10).cast("date").alias("published"))


def page_tables(rows: DataFrame, key: str, html: str) -> DataFrame:
    """(key, table, row, section, headers, cells) of the outermost tables of HTML pages.

    A table's section is its caption, else the heading before it. Header rows are joined by " | ", spans filled in;
    columns without a header are named by their place. Parsing needs Python, so it goes in batches.
    """
    from collections.abc import Iterator

    import pandas as pd

    from codexa.functions.frames import frame

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *r) for k, h in zip(b[key], b[html]) for r in _page_tables(h or "")]
            yield frame(out, [key, "table", "row", "section", "headers", "cells"])

    return rows.select(key, html).mapInPandas(go, f"{key} {dict(rows.dtypes)[key]}, table int, row int, section string, headers array<string>, cells array<string>")


def _page_tables(html: str) -> list[tuple]:
    from html.parser import HTMLParser

    class Page(HTMLParser):
        def __init__(self):
            super().__init__()
            self.heading, self.depth, self.tables, self.text, self.into = "", 0, [], [], None

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.depth += 1
                if self.depth == 1:
                    self.tables.append({"section": self.heading, "rows": []})
            elif self.depth == 1 and tag == "tr":
                self.tables[-1]["rows"].append([])
            elif self.depth == 1 and tag in ("td", "th") and self.tables[-1]["rows"]:
                span = dict(attrs).get("colspan") or "1"
                self.into, self.text = (tag, int(span) if span.isdigit() else 1), []
            elif self.depth <= 1 and (tag == "caption" or re.fullmatch("h[1-6]", tag)):
                self.into, self.text = (tag, 1), []

        def handle_data(self, data):
            self.text.append(data)

        def handle_endtag(self, tag):
            if tag == "table":
                self.depth -= 1
            if self.into is None or tag != self.into[0] or self.depth > 1:
                return
            value = " ".join("".join(self.text).split())
            if tag in ("td", "th"):
                self.tables[-1]["rows"][-1] += [(tag == "th", value)] * self.into[1]
            elif tag == "caption":
                self.tables[-1]["section"] = value
            elif not self.depth:
                self.heading = value
            self.into = None

    page = Page()
    page.feed(html)
    out = []
    for n, t in enumerate(page.tables):
        rows = [r for r in t["rows"] if r]
        heads = 0
        while heads < len(rows) and all(th for th, _ in rows[heads]):
            heads += 1
        width = max(map(len, rows), default=0)
        names = [" | ".join(dict.fromkeys(r[i][1] for r in rows[:heads] if i < len(r) and r[i][1])) or f"column_{i + 1}" for i in range(width)]
        out += [(n, k, t["section"], names, [v for _, v in r] + [""] * (width - len(r))) for k, r in enumerate(rows[heads:])]
    return out
