"""Forming flows: canonical keys, gap sessions, directions, pairs, life-span cuts and per-flow counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.operators.folds import Fold, ordered_fold
from rillflow.types import FLOW_TIMEOUT

MICRO = 1_000_000


def canonical_key(src: Column, dst: Column) -> Column:
    """One key for both directions of a conversation: the two endpoints in order."""
    return F.sort_array(F.array(src, dst))


def masked_key(ip: str | Column, prefix: int, port: str | Column, ports: tuple[int, int]) -> list[Column]:
    """Aggregated key columns: the address cut to ``prefix`` bits, and 1 for a port within the range, else 0."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    port = F.col(port) if isinstance(port, str) else port
    return [F.shiftleft(F.shiftright(ip, 32 - prefix), 32 - prefix), port.between(*ports).cast("int")]


def sessionize(packets: DataFrame, key: Sequence[str], time_us: str = "t_us", order: str = "pkt_no", timeout: float = FLOW_TIMEOUT, name: str = "session") -> DataFrame:
    """Numbers the flows of each key from 0: a new one begins where the gap reaches ``timeout`` seconds.

    The key is the bidirectional one, so that a pair ends only when both directions are idle.
    """
    w = Window.partitionBy(*key).orderBy(time_us, order)
    gap = F.col(time_us) - F.lag(time_us).over(w)
    starts = packets.withColumn("__start", F.when(gap >= int(timeout * MICRO), 1).otherwise(0))
    return starts.withColumn(name, F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__start")


def previous(rows: DataFrame, key: Sequence[str], time: str, order: str, column: str, name: str, width: int = 3_600_000_000) -> DataFrame:
    """Adds the value of ``column`` in the row before, by key in order of time.

    Rows are ordered within stretches of ``width``, and a stretch's first row takes the last value of the one
    before, so that a hot key's rows are in many tasks.
    """
    rows = rows.withColumn("__b", F.floor(F.col(time) / width))
    last = rows.groupBy(*key, "__b").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(time, order)).alias("__last"))
    last = last.withColumn("__past", F.lag("__last").over(Window.partitionBy(*key).orderBy("__b"))).drop("__last")
    w = Window.partitionBy(*key, "__b").orderBy(time, order)
    own = rows.withColumns({"__lag": F.lag(column).over(w), "__n": F.row_number().over(w)}).join(last, [*key, "__b"])
    return own.withColumn(name, F.when(F.col("__n") > 1, F.col("__lag")).otherwise(F.col("__past.v"))).drop("__b", "__lag", "__n", "__past")


def flow_stats(packets: DataFrame, key: Sequence[str], size: str, time_us: str = "t_us") -> DataFrame:
    """Packets, bytes, first and last time and duration in seconds of each flow."""
    return packets.groupBy(*key).agg(
        F.count("*").alias("pkts"), F.round(F.sum(size), 2).alias("bytes"), F.min(time_us).alias("t_first"), F.max(time_us).alias("t_last")
    ).withColumn("duration", (F.col("t_last") - F.col("t_first")) / MICRO)


def rates(flows: DataFrame) -> DataFrame:
    """Packets and bytes a second, 0 for flows without duration."""
    return flows.withColumns({n: F.round(F.when(F.col("duration") > 0, F.col(c) / F.col("duration")).otherwise(0.0), 6) for n, c in (("pktps", "pkts"), ("bytps", "bytes"))})


def inverted(first_flags: Column, src_port: Column, dst_port: Column) -> Column:
    """Whether a flow's first packet shows that the responder sent it: SYN-ACK, or from a well-known to a higher port."""
    return (first_flags.bitwiseAND(0x12) == 0x12) | ((src_port < 1024) & (src_port < dst_port))


class _Cut(Fold):
    def __init__(self, limit: int):
        self.limit, self.part, self.first = limit, -1, None

    def add(self, t: int, number) -> list[tuple]:
        if self.first is None or t - self.first >= self.limit:
            self.part, self.first = self.part + 1, t
        return [(number, self.part)]


def lifespan_cut(packets: DataFrame, key: Sequence[str], limit: float, time_us: str = "t_us", order: str = "pkt_no") -> DataFrame:
    """Cuts flows whose span since their first packet reaches ``limit`` seconds: key, packet number and ``part``, the number of the cut.

    Greedy, so a fold in time order.
    """
    return ordered_fold(packets, key, [time_us, order], [time_us, order], lambda: _Cut(int(limit * MICRO)), f"{order} long, part long")


def pair(flows: DataFrame, key: str, way: str, measures: Sequence[str]) -> DataFrame:
    """Both directions of a flow in one row: sums of A and B, and (a - b) / (a + b), 0 where both are 0. One grouping, no join."""
    out = flows.groupBy(key).agg(*(F.coalesce(F.sum(F.when(F.col(way) == d, F.col(m))), F.lit(0)).alias(f"{m}_{d.lower()}") for m in measures for d in "AB"))
    a, b = (lambda m: F.col(f"{m}_a")), (lambda m: F.col(f"{m}_b"))
    return out.withColumns({f"{m}_asym": F.round(F.when(a(m) + b(m) > 0, (a(m) - b(m)) / (a(m) + b(m)).cast("double")).otherwise(0.0), 6) for m in measures})


def biggest_talker(flows: DataFrame, by: str, who: str, order: str) -> DataFrame:
    """The sender of the largest flow; of equal ones the earliest."""
    return flows.agg(F.max_by(who, F.struct(F.col(by), -F.col(order))).alias("talker"), F.max(by).alias(by))


def interarrival(packets: DataFrame, key: Sequence[str], time_us: str = "t_us", order: str = "pkt_no") -> DataFrame:
    """Adds ``iat`` in seconds, 0 for the first packet of a key."""
    w = Window.partitionBy(*key).orderBy(time_us, order)
    return packets.withColumn("iat", F.coalesce((F.col(time_us) - F.lag(time_us).over(w)) / MICRO, F.lit(0.0)))


def min_max_avg(packets: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    return packets.groupBy(*key).agg(*(f(column).alias(n) if n != "avg" else F.round(f(column), 6).alias(n) for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))))


def running_variance(packets: DataFrame, key: Sequence[str], column: str, *order: str) -> DataFrame:
    """The streaming variance: mean of the squared distances from the running mean (not the population variance)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    off = packets.withColumn("__m", F.avg(column).over(w))
    return off.groupBy(*key).agg(F.round(F.avg((F.col(column) - F.col("__m")) * (F.col(column) - F.col("__m"))), 4).alias("run_var"))


def features(sessions: DataFrame, key: Sequence[str], time_us: str = "t_us", order: str = "pkt_no", bands: Sequence[int] = (32, 64, 128)) -> DataFrame:
    """Many features of each flow in one window and one grouping, which share a partitioning by the leading key column.

    Packets and bytes by direction and their asymmetries, times, sizes and their histogram in bands, gaps,
    flag bits and counts, ranges of time to live and window.
    """
    gap = (F.col(time_us) - F.lag(time_us).over(Window.partitionBy(*key).orderBy(time_us, order))) / MICRO
    rows = sessions.withColumn("__gap", F.coalesce(gap, F.lit(0.0)))
    way = lambda w, v: F.sum(F.when(F.col("way") == w, v).otherwise(0))
    flag = lambda bit: F.sum(F.when(F.col("tcp_flags").bitwiseAND(bit) != 0, 1).otherwise(0))
    edges = [None, *bands, None]
    inside = lambda a, b: (F.col("len") >= a if a is not None else F.lit(True)) & (F.col("len") < b if b is not None else F.lit(True))
    out = rows.groupBy(*key).agg(
        way("A", F.lit(1)).alias("pkts_a"), way("B", F.lit(1)).alias("pkts_b"), way("A", F.col("len")).alias("bytes_a"), way("B", F.col("len")).alias("bytes_b"),
        F.min(time_us).alias("t_first"), F.max(time_us).alias("t_last"), F.min("len").alias("len_min"), F.max("len").alias("len_max"), F.round(F.avg("len"), 4).alias("len_mean"), F.round(F.stddev_pop("len"), 4).alias("len_std"),
        F.max("__gap").alias("gap_max"), ((F.max(time_us) - F.min(time_us)) / F.count("*")).alias("gap_mean_us"), F.bit_or("tcp_flags").alias("flags"), flag(2).alias("syns"), flag(1).alias("fins"), flag(4).alias("resets"),
        F.min("ip_ttl").alias("ttl_min"), F.max("ip_ttl").alias("ttl_max"), F.min("tcp_win").alias("win_min"), F.max("tcp_win").alias("win_max"),
        *(F.sum(F.when(inside(a, b), 1).otherwise(0)).alias(f"band{i}") for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))),
    )
    asymmetry = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.round((F.col(a) - F.col(b)) / (F.col(a) + F.col(b)), 6)).otherwise(0.0)
    return out.withColumns({"pkts_asym": asymmetry("pkts_a", "pkts_b"), "bytes_asym": asymmetry("bytes_a", "bytes_b")})
