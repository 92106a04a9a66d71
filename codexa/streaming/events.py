"""Keyed, stateful processing of event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codexa.operators.graph import ensure_checkpoint_dir

#: Allowed moves of a run; done, failed and cancelled absorb.
MOVES = {None: {"queued", "running"}, "queued": {"running", "cancelled"}, "running": {"done", "failed", "cancelled"}}


def parquet_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A table's file as a stream; timestamps without zone become UTC ones, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, by, n, total): events per window; those later than the watermark are dropped by it."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def first_deliveries(events: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Each key once: what is delivered again within the watermark is dropped."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def _fold(state: str | None, version: int, events: list[tuple]) -> tuple[str | None, int, list[tuple]]:
    """Applies (event_id, wanted state) in order; moves that aren't allowed are refused."""
    out = []
    for event, wanted in events:
        ok = wanted in MOVES.get(state, set())
        if ok:
            state, version = wanted, version + 1
        out.append((event, wanted, ok, state, version))
    return state, version, out


def run_states(events: DataFrame, key: str, event: str, wanted: str, time: str) -> DataFrame:
    """(key, event, wanted, accepted, state, version) of a stream: a guarded state machine per key.

    State and version live in the state store, so a lost executor resumes from the checkpoint.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, version = held.get if held.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([time, event])
        state, version, out = _fold(state, version, list(zip(rows[event], rows[wanted])))
        held.update((state, version))
        yield pd.DataFrame([(k[0], *r) for r in out], columns=["key", "event", "wanted", "accepted", "state", "version"])

    kinds = dict(events.dtypes)
    schema = f"key {kinds[key]}, event {kinds[event]}, wanted string, accepted boolean, state string, version long"
    return events.select(key, event, wanted, time).groupBy(key).applyInPandasWithState(step, schema, "state string, version long", "append", GroupStateTimeout.NoTimeout)


def run_states_batch(events: DataFrame, key: str, event: str, wanted: str, time: str) -> DataFrame:
    """The same over a finished log: replay of each key's events in order."""
    kinds = dict(events.dtypes)

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([time, event])
        _, _, out = _fold(None, 0, list(zip(rows[event], rows[wanted])))
        return pd.DataFrame([(rows[key].iloc[0], *r) for r in out], columns=["key", "event", "wanted", "accepted", "state", "version"])

    schema = f"key {kinds[key]}, event {kinds[event]}, wanted string, accepted boolean, state string, version long"
    return events.select(key, event, wanted, time).groupBy(key).applyInPandas(replay, schema)


def versioned_updates(rows: DataFrame, key: str, event: str, expected: str, time: str) -> DataFrame:
    """(key, event, accepted, version): updates in order, each taken only if it expects the version its key has then; a taken one raises it."""
    kinds = dict(rows.dtypes)

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values([time, event])
        version, out = 0, []
        for e, x in zip(b[event], b[expected]):
            ok = bool(x == version)
            version += ok
            out.append((b[key].iloc[0], e, ok, version))
        return pd.DataFrame(out, columns=["key", "event", "accepted", "version"])

    return rows.select(key, event, expected, time).groupBy(key).applyInPandas(fold, f"key {kinds[key]}, event {kinds[event]}, accepted boolean, version long")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, and returns its output, written below the session's checkpoint folder.

    Appended rows go to a Parquet sink; other modes replace the output with each batch, which bears being called again.
    """
    spark = stream.sparkSession
    ensure_checkpoint_dir(stream)
    folder = f"{spark.sparkContext.getCheckpointDir()}/streams/{name}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").start(f"{folder}/rows")
    else:
        q = w.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def into_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch through a function that must bear being called again with the same batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def split_bad(rows: DataFrame, ok) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those to be delivered again."""
    ok = F.coalesce(ok, F.lit(False))
    return rows.where(ok), rows.where(~ok)
