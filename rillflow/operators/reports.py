"""Aggregations over flow tables: top lists, percentages, A/B reports, distinct values, comparisons, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillflow.operators.lookups import small

MEASURES = {"flows": lambda: F.count("*"), "pkts": lambda: F.sum("pkts_snt"), "bytes": lambda: F.sum("bytes_snt")}


def aggregate(flows: DataFrame, by: Sequence[str | Column], values: dict[str, Column] | None = None, n: int = 0) -> DataFrame:
    """Sums of values (or the number of flows) by key, largest first value first: the first ``n``, the last ``-n``, or all for 0."""
    values = values or {"flows": F.count("*")}
    out = flows.groupBy(*by).agg(*(v.alias(k) for k, v in values.items()))
    first, keys = next(iter(values)), [c for c in out.columns if c not in values]
    if n == 0:
        return out
    return out.orderBy(F.desc(first) if n > 0 else F.asc(first), *keys).limit(abs(n))


def aggregate_lists(flows: DataFrame, column: str, separator: str = ";", ignore_empty: bool = True, n: int = 0) -> DataFrame:
    """The same over the items of a repetitive column."""
    items = flows.select(F.explode(F.split(F.coalesce(column, F.lit("")), separator)).alias(column))
    return aggregate(items.where(F.col(column) != "") if ignore_empty else items, [column], n=n)


def outward(a: str, b: str) -> Column:
    """The initiator's side of a flow: ``a`` unless the flow is inverted. One scan instead of a union of A and B halves."""
    return F.when(F.col("flow_stat").bitwiseAND(1) == 0, F.col(a)).otherwise(F.col(b))


def within(flows: DataFrame, time_from=None, time_to=None, first: str = "day_first", last: str = "day_first") -> DataFrame:
    """Flows that begin at or after ``time_from`` and end at or before ``time_to``; None leaves a side open. On a table partitioned by the column only its days are read."""
    if time_from is not None:
        flows = flows.where(F.col(first) >= F.lit(time_from))
    return flows if time_to is None else flows.where(F.col(last) <= F.lit(time_to))


def top(flows: DataFrame, label: Column, name: str, measure: str, n: int = 10, where: Column | None = None, time_from=None, time_to=None) -> DataFrame:
    rows = within(flows if where is None else flows.where(where), time_from, time_to)
    return rows.groupBy(label.alias(name)).agg(MEASURES[measure]().alias(measure)).orderBy(F.desc(measure), name).limit(n)


def alarmed(flows: DataFrame, *alarms: Column) -> DataFrame:
    """Flows for which some alarm holds; an alarm that is null doesn't."""
    return flows.where(reduce(lambda a, b: a | b, (F.coalesce(a, F.lit(False)) for a in alarms)))


def top_percent(flows: DataFrame, by: Sequence[str], weight: Column, least: float = 0.0, most: float = 100.0, where: Column | None = None) -> DataFrame:
    """Weight and its percentage by key; the total is taken before the filter, the percentages' band after."""
    total = flows.agg(weight.alias("__total"))
    out = (flows if where is None else flows.where(where)).groupBy(*by).agg(weight.alias("weight"))
    out = out.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100.0 * F.col("weight") / F.col("__total"), 4)).drop("__total")  # one row
    return out.where(F.col("percent").between(least, most))


def summary(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count("*").alias("flows"), F.min("day_first").alias("first"), F.max("day_first").alias("last"), F.sum("pkts_snt").alias("pkts"), F.sum("bytes_snt").alias("bytes"))


def unique_hosts(flows: DataFrame) -> DataFrame:
    """Every address that sent or received."""
    return flows.select("src_ip").distinct().union(flows.select("dst_ip").distinct()).distinct().toDF("ip")


def protocol_totals(packets: DataFrame, proto: str, port: str, size: str) -> DataFrame:
    """Packets and bytes by protocol and port, their subtotals and the total, each with its share of all packets."""
    out = packets.rollup(proto, port).agg(F.count("*").alias("pkts"), F.sum(size).alias("bytes"), F.grouping_id().alias("level"))
    total = F.max(F.when(F.col("level") == 3, F.col("pkts"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("percent", F.round(100.0 * F.col("pkts") / total, 4))


def differing_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Per column, how many rows of the same key differ; rows on one side only differ in every column."""
    names = [c for c in left.columns if c != key]
    both = left.alias("l").join(right.alias("r"), key, "full")
    sums = both.agg(*(F.sum(F.when(F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), 0).otherwise(1)).alias(c) for c in names))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("differing")) for c in names))).alias("x")).select("x.*")


def monitor(packets: DataFrame, time: str, interval: str, size: str) -> DataFrame:
    """Counters of each interval, and what changed since the interval before."""
    w = Window.orderBy("t")
    out = packets.groupBy(F.window(time, interval).start.alias("t")).agg(F.count("*").alias("pkts"), F.sum(size).alias("bytes"))
    return out.withColumns({"pkts_diff": F.col("pkts") - F.coalesce(F.lag("pkts").over(w), F.lit(0)), "bytes_diff": F.col("bytes") - F.coalesce(F.lag("bytes").over(w), F.lit(0))})


def classified(flows: DataFrame, classes: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    return flows.join(small(classes), list(on), "left").withColumn(label, F.coalesce(label, F.lit("unknown")))
