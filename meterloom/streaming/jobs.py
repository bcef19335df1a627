"""Structured Streaming forms of the roll-up, window, change-point, outage and scoring operators.

Input streams have user_id, ts, value (and event_type, event_id). Sinks and checkpoints go to the shared checkpoint folder.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState

from ..sources.sinks import scratch

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
                       T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, glob: str = "events*.parquet", per_trigger: int | None = None) -> DataFrame:
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob)
    s = (s.option("maxFilesPerTrigger", per_trigger) if per_trigger else s).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


class LateRows(RuntimeError):
    """Rows came after the watermark had passed them; the delay is too short for this order of files."""


def _run(stream: DataFrame, out: str, state: str) -> list[str]:
    """Run over all available input; the event times seen."""
    stream.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    q = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    progress = q.recentProgress
    late = sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])
    if late:
        raise LateRows(f"{late} rows dropped by the watermark")
    return [p["eventTime"]["max"] for p in progress if "max" in (p["eventTime"] or {})]


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a job without state over all available input into a Parquet table and read it back."""
    spark = stream.sparkSession
    out = scratch(spark, f"stream-{name}")
    _run(stream, out, scratch(spark, f"stream-{name}-state"))
    return spark.read.schema(stream.schema).parquet(out)


def run_whole(events: DataFrame, job: Callable[..., DataFrame], name: str, delay: str = "1 day", **options) -> DataFrame:
    """job(events, delay=delay, **options) over all available input, then once more with a tick far in the future, which
    closes every window and session that is still open. The table read back equals the batch answer; if the watermark
    would drop a row the run fails (LateRows) and wants a longer delay.
    """
    spark = events.sparkSession
    out, state, folder = (scratch(spark, f"stream-{name}{x}") for x in ("", "-state", "-ticks"))
    spark.createDataFrame([], EVENTS).write.parquet(folder)
    ticks = spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = job(events.unionByName(ticks), delay=delay, **options)
    seen = _run(stream, out, state)
    if seen:
        last = F.lit(max(seen).rstrip("Z")).cast("timestamp_ntz")
        tick = spark.range(1).select(*[(last + F.expr(f"INTERVAL {delay}") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 3650 DAYS") if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENTS])
        tick.write.mode("append").parquet(folder)
        _run(stream, out, state)
    return spark.read.schema(stream.schema).parquet(out)


def daily_rollup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Duplicate events dropped within the watermark, then count and sum per user and day; late rows are discarded."""
    e = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    g = e.groupBy(F.window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.to_date("window.start").alias("day"), "n", "total")


def sliding_stats(events: DataFrame, width: str = "72 hours", step: str = "24 hours", delay: str = "1 day") -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("hi"))
    return g.select("event_type", F.col("window.start").alias("start"), "n", "mean", "hi")


def outages(events: DataFrame, gap: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Sessions of activity per user; the time between sessions is a missing-data outage of at least `gap`."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))
    return g.select("user_id", F.col("session_window.start").alias("first_ts"), "last_ts", "n")


def gated_scores(events: DataFrame, profile: DataFrame, gate: float = 0.8) -> DataFrame:
    """Join the stream with a static per-user profile and route each event: automatic or review."""
    x = events.join(profile, "user_id")
    p = 1 / (1 + F.exp(-(F.col("value") - F.col("mu")) / (F.col("sd") + 1e-6)))
    route = F.when(p >= gate, "alert").when(p <= 1 - gate, "pass").otherwise("review")
    return x.select("event_id", "user_id", F.round(p, 6).alias("p"), route.alias("route"))


ALARM_STATE = "n bigint, total double, squares double, up double, down double, done boolean, ts array<bigint>, ids array<bigint>, vals array<double>"


def shift_alarms(events: DataFrame, warmup: int = 20, drift: float = 0.2, threshold: float = 3.0, delay: str = "1 day") -> DataFrame:
    """First alarm of the two-sided cumulative sums per user; level and scale come from the first `warmup` points.

    Rows wait in the state until the watermark has passed them and are then taken in order of (ts, event_id), so neither
    files, triggers nor Arrow batches decide an alarm. What waits for a key is what lies within the delay."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s, q, up, down, done, *wait = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, False, [], [], [])
        new = [(b.ts.to_numpy("datetime64[us]").astype(np.int64), b.event_id.fillna(-1).to_numpy(np.int64), b.value.to_numpy(float)) for b in batches]
        ts, ids, x = (np.concatenate([np.asarray(w, k), *(b[i] for b in new)]) for i, (w, k) in enumerate(zip(wait, (np.int64, np.int64, float))))
        order = np.lexsort((ids, ts))
        ts, ids, x = ts[order], ids[order], x[order]
        passed = state.getCurrentWatermarkMs() * 1000
        due = int(np.searchsorted(ts, passed, "right"))
        first = x[:min(due, max(0, warmup - n))]
        s, q = s + float(first.sum()), q + float((first ** 2).sum())
        rest, at = x[len(first):due], n + len(first)
        if len(rest):
            mu = s / warmup
            sd = max(q / warmup - mu * mu, 0.0) ** 0.5 + 1e-6
            ups, downs = (np.cumsum(sign * (rest - mu) - drift * sd) + start for sign, start in ((1, up), (-1, down)))
            ups, downs = (c - np.minimum(0, np.minimum.accumulate(c)) for c in (ups, downs))
            hit = np.flatnonzero(np.maximum(ups, downs) > threshold * sd)
            if len(hit) and not done:
                i, done = int(hit[0]), True
                yield pd.DataFrame({"user_id": [key[0]], "ts": [pd.Timestamp(int(ts[len(first) + i]), unit="us")], "n": [at + i + 1], "direction": ["rise" if ups[i] > downs[i] else "drop"]})
            up, down = float(ups[-1]), float(downs[-1])
        state.update((n + due, s, q, up, down, done, ts[due:].tolist(), ids[due:].tolist(), x[due:].tolist()))
        if due < len(ts):
            state.setTimeoutTimestamp(max(int(ts[due]) // 1000, passed // 1000) + 1)

    return events.withWatermark("ts", delay).groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, ts timestamp, n bigint, direction string", ALARM_STATE, "append", "EventTimeTimeout")
