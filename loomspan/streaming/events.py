"""Structured Streaming over event logs: idempotent append, session heads, token buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 1) -> DataFrame:
    """Event files as they arrive (M9)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Each event id once (M1).

    Without a delay ids are remembered for good, as the log it follows does;
    with one, state is bounded and a copy later than the watermark passes again.
    """
    if delay is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def heads(events: DataFrame) -> DataFrame:
    """Running session heads (M2), for update or complete mode."""
    return events.groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("event_count"), F.max_by("event_type", "event_id").alias("last_kind"))


def counts_by_window(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events of each kind in fixed windows, late ones within the delay included."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def admit(events: pd.DataFrame | dict[str, list[float]], rate: float, burst: float, tokens: float, last: float | None) -> tuple[list[bool], float, float | None]:
    """Token bucket over events in order of time (M5): which are admitted, and the state after them."""
    out = []
    for t in events["t"]:
        if last is not None:
            tokens = min(burst, tokens + max(0.0, t - last) * rate)
        last = t if last is None else max(last, t)
        ok = tokens >= 1.0
        tokens -= 1.0 if ok else 0.0
        out.append(ok)
    return out, tokens, last


def token_bucket(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """user_id, event_id, admitted: a bucket per user, its state kept across batches (M5)."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
        user, event, t = (pdf[c].to_numpy() for c in ("user_id", "event_id", "t"))
        order = np.lexsort((event, t))
        tokens, last = state.get if state.exists else (float(burst), None)
        ok, tokens, last = admit({"t": t[order].tolist()}, rate, burst, tokens, last)
        state.update((tokens, last))
        yield pd.DataFrame({"user_id": user[order], "event_id": event[order], "admitted": ok})

    timed = events.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, admitted boolean", "tokens double, last double", "append", "NoTimeout")


def run_once(df: DataFrame, name: str, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Everything that is there, then stop: into a table, or batch by batch into ``each``.

    Rows that are appended go from the tasks to Parquet files beside the checkpoint. A
    table in memory is held by the driver whole, so it is for complete mode alone.
    """
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    rows = f"{checkpoint}-{name}"
    if each:
        w = w.foreachBatch(each)
    else:
        w = w.queryName(name).format("memory") if mode == "complete" else w.queryName(name).format("parquet").option("path", rows)
    w.start().awaitTermination()
    if each:
        return None
    return df.sparkSession.table(name) if mode == "complete" else df.sparkSession.read.schema(df.schema).parquet(rows)
