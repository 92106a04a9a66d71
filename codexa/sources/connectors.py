"""Sources that Spark has no reader for: paged bundles of records, and SQLite files opened read-only.

    spark.dataSource.register(BundlePages)
    spark.read.format("bundle_pages").option("start", "/shared/page-0.json").load()
"""

from __future__ import annotations

import json
import os
import sqlite3
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fetched(address: str) -> dict:
    """A page of JSON from a path or an address; a cache on the way is asked to pass it by."""
    if "://" not in address:
        with open(address, encoding="utf-8") as f:
            return json.load(f)
    ask = urllib.request.Request(address, headers={"Accept": "application/json", "Cache-Control": "no-cache"})
    with urllib.request.urlopen(ask, timeout=60) as r:
        return json.load(r)


def _next(page: dict, address: str) -> str | None:
    to = next((x.get("url") for x in page.get("link") or [] if x.get("relation") == "next"), None)
    if to is None or "://" in to or "://" not in address and os.path.isabs(to):
        return to
    return urllib.parse.urljoin(address, to) if "://" in address else os.path.join(os.path.dirname(address), to)


class BundlePages(DataSource):
    """(page, place, type, id, resource): entries of bundles, from each start page (option ``start``, commas between) along its links of relation next.

    A chain of pages is only known by walking it, so each start is a partition. A page that comes again ends its chain.
    """

    @classmethod
    def name(cls) -> str:
        return "bundle_pages"

    def schema(self) -> str:
        return "page int, place int, type string, id string, resource string"

    def reader(self, schema) -> DataSourceReader:
        return _BundleReader(self.options)


class _BundleReader(DataSourceReader):
    def __init__(self, options):
        self.starts = [x.strip() for x in options.get("start", "").split(",") if x.strip()]
        self.most = int(options.get("maxpages", options.get("maxPages", "100000")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(x) for x in self.starts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        address, seen = partition.value, set()
        while address and address not in seen:
            if len(seen) >= self.most:
                raise ValueError(f"more than {self.most} pages from {partition.value}")
            page = _fetched(address)
            for n, e in enumerate(page.get("entry") or []):
                r = e.get("resource") or {}
                yield len(seen), n, r.get("resourceType"), r.get("id"), json.dumps(r, sort_keys=True)
            seen.add(address)
            address = _next(page, address)


class SqliteReadOnly(DataSource):
    """Rows of a table (options ``path`` and ``table``) as texts by column, read without a write lock, in ranges of rowid (option ``ranges``)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_read_only"

    def schema(self) -> str:
        with _opened(self.options["path"]) as con:
            kinds = {"INT": "bigint", "REAL": "double", "DOUB": "double", "FLOA": "double"}
            cols = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {kinds.get((c[2] or '').upper()[:4].rstrip('E'), kinds.get((c[2] or '').upper()[:3], 'string'))}" for c in cols)

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options, schema)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{urllib.parse.quote(path)}?mode=ro", uri=True)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.ranges = options["path"], options["table"], int(options.get("ranges", "1"))
        self.fields = [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as con:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if lo is None:
            return []
        step = -(-(hi - lo + 1) // self.ranges)
        return [InputPartition((a, min(hi, a + step - 1))) for a in range(lo, hi + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cast = {"long": int, "double": float}
        cols = ", ".join(_quoted(n) for n, _ in self.fields)
        with _opened(self.path) as con:
            for row in con.execute(f"SELECT {cols} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", partition.value):
                yield tuple(None if v is None else cast.get(t, str)(v) for v, (_, t) in zip(row, self.fields))
