"""Connection-degree counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distinct_peers(flows: DataFrame, who: str, peer: str) -> DataFrame:
    """Distinct peers and flows of each host."""
    return flows.groupBy(who).agg(F.countDistinct(peer).alias("peers"), F.count("*").alias("flows"))


def active_overlap(flows: DataFrame, key: Sequence[str], start: str, end: str, order: str, width: int = 3_600_000_000) -> DataFrame:
    """The most flows of a key that are live at once: +1 where one starts, -1 where it ends, summed over time (starts first).

    Sums run within stretches of ``width`` on top of the sum of the stretches before, so that a hot key's marks are in many tasks.
    """
    marks = flows.select(*key, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d"), F.col(order).alias("o")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"), F.col(order).alias("o")))).alias("m")).select(*key, "m.*")
    marks = marks.withColumn("b", F.floor(F.col("t") / width))
    w = Window.partitionBy(*key, "b").orderBy("t", F.desc("d"), "o").rowsBetween(Window.unboundedPreceding, 0)
    stretches = marks.withColumn("live", F.sum("d").over(w)).groupBy(*key, "b").agg(F.max("live").alias("top"), F.sum("d").alias("all"))
    before = F.coalesce(F.sum("all").over(Window.partitionBy(*key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return stretches.withColumn("live", F.col("top") + before).groupBy(*key).agg(F.max("live").alias("most_live"))


def live_peers(flows: DataFrame, who: Sequence[str], peer: Sequence[str], start: str, end: str, flow: str, name: str) -> DataFrame:
    """``flow, name``: how many distinct peers of a flow's key have a live flow with it when the flow ends, itself included.

    The flows of a key and peer that touch are one stretch; stretches are +1 and -1 marks over time, and a
    flow reads their sum at its end. Without ``peer`` columns the live flows themselves are counted.
    """
    rows = flows.select(*who, *peer, start, end, flow)
    if peer:
        in_order = Window.partitionBy(*who, *peer).orderBy(start, end)
        reach = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        stretches = rows.groupBy(*who, *peer, "__run").agg(F.min(start).alias("__s"), F.max(end).alias("__e"))
    else:
        stretches = rows.select(*who, F.col(start).alias("__s"), F.col(end).alias("__e"))
    mark = lambda t, d, rank, f=F.lit(None): F.struct(t.alias("t"), F.lit(d).alias("d"), F.lit(rank).alias("rank"), f.cast("long").alias("f"))
    marks = stretches.select(*who, F.explode(F.array(mark(F.col("__s"), 1, 0), mark(F.col("__e"), -1, 2))).alias("m"))
    marks = marks.unionByName(rows.select(*who, mark(F.col(end), 0, 1, F.col(flow)).alias("m"))).select(*who, "m.*")
    live = F.sum("d").over(Window.partitionBy(*who).orderBy("t", "rank", "f").rowsBetween(Window.unboundedPreceding, 0))
    return marks.withColumn(name, live).where("rank = 1").select(F.col("f").alias(flow), name)


def connection_counters(flows: DataFrame, src: str, dst: str, port: str, start: str, end: str, flow: str) -> DataFrame:
    """Counters of each flow at its end: live peers of its source and of its destination, live flows of the pair, live peers of source and port, and the last over the first."""
    parts = [live_peers(flows, *args, start, end, flow, name) for args, name in ((([src], [dst]), "conn_src"), (([dst], [src]), "conn_dst"), (([src, dst], []), "conn_pair"), (([src, port], [dst]), "conn_src_port"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, flow)
    return out.withColumn("conn_f", F.round(F.col("conn_src_port") / F.col("conn_src"), 6))


def connection_ratio(flows: DataFrame, src: str, dst: str, port: str) -> DataFrame:
    """Flows to a port over distinct peers, by source and port."""
    per_port = flows.groupBy(src, port).agg(F.count("*").alias("port_flows"))
    peers = flows.groupBy(F.col(src).alias("__src")).agg(F.countDistinct(dst).alias("peers"))
    return per_port.join(peers, per_port[src] == F.col("__src")).select(src, port, "port_flows", "peers", F.round(F.col("port_flows") / F.col("peers"), 6).alias("conn_f"))
