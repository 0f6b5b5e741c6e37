"""Streaming queries, run over all available input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rillflow.plans.registry import P, S, query
from rillflow.streaming import sessions
from rillflow.sources.tables import packets, table

#: The files of a table are in no order of time, so no row of theirs is too late.
NEVER = "36500 days"


def _places(spark: SparkSession) -> tuple[str, str]:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="rillflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    run = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"


def _events(spark: SparkSession, d: str):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1000).parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("len", F.floor(F.abs("value")))


@query(f"WITH {S} SELECT user_id, min(t_us) AS t_first, count(*) AS pkts, CAST(sum(len) AS BIGINT) AS bytes FROM s GROUP BY user_id, session")
def sessions_stream(spark, d):
    """Sessions that the watermark closed and those still open at the end of the input; no row is too late."""
    out, state = _places(spark)
    done = sessions.run_available(spark, sessions.session_windows(_events(spark, d), "ts", ["user_id"], "len", 21_600, late=NEVER), out, state)
    return done.unionByName(sessions.open_sessions(spark, state, ["user_id"])).select("user_id", F.unix_micros("t_first").alias("t_first"), "pkts", "bytes")


@query(f"WITH {P} SELECT CAST(floor(t_us / 3600000000) AS BIGINT) AS hour, count(*) AS pkts, CAST(sum(len) AS BIGINT) AS bytes FROM p GROUP BY ALL")
def monitoring_stream(spark, d):
    """Intervals that the watermark closed and those still open at the end of the input; no row is too late."""
    out, state = _places(spark)
    done = sessions.run_available(spark, sessions.monitoring(_events(spark, d), "ts", "1 hour", "len", late=NEVER), out, state)
    return done.unionByName(sessions.open_windows(spark, state)).select(F.floor(F.unix_micros("t") / 3_600_000_000).alias("hour"), "pkts", "bytes")


@query(f"""WITH {P}, w AS (SELECT user_id, t_us, max(t_us) OVER (PARTITION BY user_id ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p)
    SELECT user_id, count(*) FILTER (b > t_us) AS jumps, max(greatest(coalesce(b - t_us, 0), 0)) AS farthest FROM w GROUP BY user_id""")
def time_jumps(spark, d):
    return sessions.time_jumps(packets(spark, d), ["user_id"], "t_us", "pkt_no")


@query(f"WITH {S} SELECT user_id AS key, min(t_us) AS t_first, max(t_us) AS t_last, count(*) AS pkts, CAST(sum(len) AS DOUBLE) AS bytes FROM s GROUP BY user_id, session")
def stateful_flows_stream(spark, d):
    """All flows: those that a timer ended and those still open at the end of the input; no row is too late."""
    out, state = _places(spark)
    ended = sessions.run_available(spark, sessions.stateful_flows(_events(spark, d), "user_id", "ts", "len", 21_600, late=NEVER), out, state)
    return ended.unionByName(sessions.open_flows(spark, state))
