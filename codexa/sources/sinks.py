"""Writers: JSON lines, flat CSV, keyed replacement, append-only logs."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexa.operators.relational import upsert


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the whole job is committed or nothing of it."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_flat_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays become texts joined by semicolons."""
    flat = [F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces only the partitions that the rows belong to; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, keys: list[str], version: int) -> str:
    """Writes the table with new rows laid over the old as a further version, and returns its folder.

    A reader of the old version isn't disturbed; a null in a new row keeps the stored value.
    """
    target = f"{path}/v{version}"
    old = spark.read.parquet(f"{path}/v{version - 1}") if version else None
    (new if old is None else upsert(old, new, keys)).write.mode("errorifexists").parquet(target)
    return target


def write_postings(df: DataFrame, path: str, buckets: int = 64) -> None:
    """An inverted index, laid out by a hash of the term so that a lookup reads one folder."""
    df.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def markdown_report(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; refuses results of more rows than a report holds."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in rows)])


def write_json_atomic(value, path: str, indent: int | None = 2, sort_keys: bool = False) -> None:
    """One JSON document, put in place at once: a reader sees the old one or the new one."""
    text = json.dumps(value, indent=indent, ensure_ascii=False, sort_keys=sort_keys)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise


def upsert_vectors(spark: SparkSession, new: DataFrame, path: str, key: str, vector: str, version: int) -> str:
    """Rows by key with their vector as JSON text beside it, laid over what is there, as a further version."""
    return upsert_parquet(spark, new.withColumn(f"{vector}_json", F.to_json(vector)), path, [key], version)


def rebuild_tables(tables: dict[str, DataFrame], path: str, build: str) -> str:
    """Several tables as one build below ``path``, named in its ``current`` file only once all are written; returns the build's folder.

    Readers take the folder from ``current_build``, so a build that breaks off is never read.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{build}/{name}")
    write_json_atomic({"build": build, "tables": sorted(tables)}, f"{path}/current")
    return f"{path}/{build}"


def current_build(path: str) -> str:
    with open(f"{path}/current", encoding="utf-8") as f:
        return f"{path}/{json.load(f)['build']}"
