"""Streaming: sessions with state that follows the connection, session windows, and monitoring counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.types import FLOW_TIMEOUT


def session_windows(stream: DataFrame, time: str, key: list[str], size: str, timeout: float = FLOW_TIMEOUT, late: str = "0 seconds") -> DataFrame:
    """Gap sessions of a stream: packets and bytes of each, emitted once the watermark passes its end."""
    window = F.session_window(time, f"{int(timeout * 1000)} milliseconds")
    return stream.withWatermark(time, late).groupBy(window.alias("w"), *key).agg(F.count("*").alias("pkts"), F.sum(size).alias("bytes")).select(*key, F.col("w.start").alias("t_first"), "pkts", "bytes")


def monitoring(stream: DataFrame, time: str, interval: str, size: str, late: str = "0 seconds") -> DataFrame:
    """Counters of each tumbling interval."""
    return stream.withWatermark(time, late).groupBy(F.window(time, interval).alias("w")).agg(F.count("*").alias("pkts"), F.sum(size).alias("bytes")).select(F.col("w.start").alias("t"), "pkts", "bytes")


def grown(flows: list[tuple], t: np.ndarray, n: np.ndarray, limit: int) -> list[tuple]:
    """``flows`` (first, last, packets, size) with packets at the times ``t``, in any order, of the sizes ``n``; a gap of ``limit`` parts two flows.

    Plain arrays: a key has few packets, and a data frame's own cost for each key would be a multiple of the work.
    """
    if not len(t):
        return flows
    order = np.argsort(t, kind="stable")
    t = t[order]
    starts = np.flatnonzero(np.diff(t, prepend=t[:1] - limit) >= limit)
    counts = np.diff(np.append(starts, len(t)))
    merged: list[tuple] = []
    for first, last, pkts, total in sorted([*flows, *zip(t[starts].tolist(), np.fmax.reduceat(t, starts).tolist(), counts.tolist(), np.add.reduceat(n[order], starts).tolist(), strict=True)]):
        if merged and first - merged[-1][1] < limit:
            a, b, k, size = merged[-1]
            merged[-1] = (a, max(b, last), k + pkts, size + total)
        else:
            merged.append((first, last, pkts, total))
    return merged


def stateful_flows(stream: DataFrame, key: str, time: str, size: str, timeout: float = FLOW_TIMEOUT, late: str = "0 seconds") -> DataFrame:
    """Flows with state of one's own: both directions of a key share a state, a timer ends it when both are idle.

    The state is four numbers for each flow that may still grow, in any order of packets; the frames of a
    key are folded into it one by one. ``late`` bounds how far packets may be out of order: what comes later
    than the watermark is dropped. ``open_flows`` reads what is left in the state at the end of the input.
    """
    limit = int(timeout * 1_000_000)

    def fold(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        flows = list(zip(*state.get, strict=True)) if state.exists else []
        for rows in frames if not state.hasTimedOut else ():
            flows = grown(flows, rows["t"].to_numpy(), rows["n"].fillna(0.0).to_numpy(), limit)
        now = state.getCurrentWatermarkMs()
        done = [(k[0], *f) for f in flows if f[1] + limit <= now * 1000]
        flows = [f for f in flows if f[1] + limit > now * 1000]
        if flows:
            state.update(tuple(map(list, zip(*flows, strict=True))))
            state.setTimeoutTimestamp(max(-(-(flows[0][1] + limit) // 1000), now + 1))
        elif state.exists:
            state.remove()
        if done:  # a frame costs more than the fold
            yield pd.DataFrame(done, columns=["key", "t_first", "t_last", "pkts", "bytes"])

    rows = stream.withWatermark(time, late).select(F.col(key).cast("long").alias("key"), time, F.unix_micros(time).alias("t"), F.col(size).cast("double").alias("n"))
    return rows.groupBy("key").applyInPandasWithState(fold, "key long, t_first long, t_last long, pkts long, bytes double", "first array<long>, last array<long>, pkts array<long>, total array<double>", "append", "EventTimeTimeout")


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The flows that ``stateful_flows`` still holds in its state when its input has ended."""
    held = spark.read.format("statestore").load(checkpoint).select(F.col("key.*"), F.col("value.groupState").alias("s"))
    flows = held.select("key", F.explode(F.arrays_zip("s.first", "s.last", "s.pkts", "s.total")).alias("f"))
    return flows.select("key", F.col("f.first").alias("t_first"), F.col("f.last").alias("t_last"), F.col("f.pkts").alias("pkts"), F.col("f.total").alias("bytes"))


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The intervals that ``monitoring`` still holds in its state when its input has ended."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(F.col("key.window.start").alias("t"), F.col("value.count").alias("pkts"), F.col("value.sum").alias("bytes"))


def open_sessions(spark: SparkSession, checkpoint: str, key: list[str]) -> DataFrame:
    """The sessions that ``session_windows`` still holds in its state when its input has ended."""
    held = spark.read.format("statestore").load(checkpoint)
    return held.select(*(F.col(f"key.{k}").alias(k) for k in key), F.col("value.session_window.start").alias("t_first"), F.col("value.count").alias("pkts"), F.col("value.sum").alias("bytes"))


def run_available(spark: SparkSession, out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a streaming frame over all that is available, appending what is complete to a table at ``path``, and reads it."""
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def time_jumps(packets: DataFrame, key: list[str], time_us: str, arrival: str) -> DataFrame:
    """Packets whose time lies before that of a packet that arrived earlier, by key: how many, and how far back at most."""
    w = Window.partitionBy(*key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    back = F.greatest(F.max(time_us).over(w) - F.col(time_us), F.lit(0))
    return packets.withColumn("__back", F.coalesce(back, F.lit(0))).groupBy(*key).agg(F.sum(F.when(F.col("__back") > 0, 1).otherwise(0)).alias("jumps"), F.max("__back").alias("farthest"))
