"""Histograms and descriptive statistics with the engine's own quantile and moment rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def iat_bin(ms: Column) -> Column:
    """Bins of 1 ms below 200, 5 ms below 400, 10 ms below 1000, and one for all above."""
    return F.when(ms < 200, F.floor(ms)).when(ms < 400, 200 + F.floor((ms - 200) / 5)).when(ms < 1000, 240 + F.floor((ms - 400) / 10)).otherwise(300).cast("long")


def bin_edge(b: Column) -> Column:
    """The lower edge of a bin in ms."""
    return F.when(b < 200, b).when(b < 240, 200 + (b - 200) * 5).when(b <= 300, 400 + (b - 240) * 10)


def size_iat_histogram(packets: DataFrame, key: Sequence[str], size: str, ms: str) -> DataFrame:
    """Counts by packet size and inter-arrival bin, with the marginal counts of either."""
    cells = packets.groupBy(*key, F.col(size).alias("size"), iat_bin(F.col(ms)).alias("bin")).agg(F.count("*").alias("cnt"))
    return cells.withColumns({"size_cnt": F.sum("cnt").over(Window.partitionBy(*key, "size")), "bin_cnt": F.sum("cnt").over(Window.partitionBy(*key, "bin"))})


def value_histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Zeros and nulls skipped; the range ends at the power of ten above the largest value; percent of the counted rows, empty bins too."""
    used = rows.where(F.col(column) > 0)
    top = used.agg(F.max(column).alias("__max")).select(F.pow(F.lit(10.0), F.floor(F.log10("__max")) + 1).alias("__top"))
    width = F.col("__top") / bins
    counted = used.crossJoin(F.broadcast(top)).groupBy(F.least(F.floor(F.col(column) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    edges = top.select("__top", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    out = edges.join(counted, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return out.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))


def _ranked(rows: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Distinct values of each key with their counts and the ranks that they cover."""
    cells = rows.groupBy(*key, F.col(column).alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key).orderBy("x")
    return cells.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*key)))


def _at(position: Column) -> Column:
    """The value at a 1-based rank within [1, n]."""
    p = F.greatest(F.lit(1), F.least(position, F.col("n")))
    return F.max(F.when((F.col("upto") >= p) & (F.col("upto") - F.col("c") < p), F.col("x")))


def length_stats(packets: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """min, max, mean, quartiles at rank ``n * q + 0.5`` (linear between neighbours), mode (smallest of ties), std, skew and excess with 1/n.

    Works on distinct values with counts, so a hot key costs one row per value after the partial sums.
    """
    r = _ranked(packets, key, column)
    quartile = {}
    for name, q in (("q1", 0.25), ("med", 0.5), ("q3", 0.75)):
        pos = F.col("n") * q + 0.5
        quartile[name] = (_at(F.floor(pos)), _at(F.ceil(pos)), F.max(pos - F.floor(pos)))
    total, n = F.sum(F.col("x") * F.col("c")), F.sum("c")
    base = r.groupBy(*key).agg(
        F.min("x").alias("min"), F.max("x").alias("max"), (total / n).alias("mean"), n.alias("n_all"), F.max_by("x", F.struct(F.col("c"), -F.col("x"))).alias("mode"),
        *(e.alias(f"{k}_{i}") for k, es in quartile.items() for i, e in enumerate(es)),
    )
    moments = r.join(base.select(*key, "mean"), list(key)).groupBy(*key).agg(*((F.sum(F.col("c") * F.pow(F.col("x") - F.col("mean"), F.lit(float(p)))) / F.sum("c")).alias(f"m{p}") for p in (2, 3, 4)))
    out = base.join(moments, list(key))
    single = F.col("n_all") == 1
    value = lambda k: F.when(single, F.col("min")).otherwise(F.col(f"{k}_0") + (F.col(f"{k}_1") - F.col(f"{k}_0")) * F.col(f"{k}_2"))
    std = F.sqrt("m2")
    return out.select(
        *key, "min", "max", F.round("mean", 4).alias("mean"), *(F.round(value(k), 4).alias(k) for k in quartile), "mode", F.round(std, 4).alias("std"),
        F.round(F.least(std, 0.7413 * (value("q3") - value("q1"))), 6).alias("robust_std"),
        F.round(F.when(F.col("m2") > 0, F.col("m3") / F.pow(std, F.lit(3.0))).otherwise(0.0), 4).alias("skew"),
        F.round(F.when(F.col("m2") > 0, F.col("m4") / F.pow(F.col("m2"), F.lit(2.0)) - 3).otherwise(0.0), 4).alias("excess"),
    )


def iat_quartiles(packets: DataFrame, key: Sequence[str], ms: str) -> DataFrame:
    """Quartiles of binned inter-arrival times: rank ``(n - 1) * q + 1`` of bin midpoints; a whole rank averages it with the next, a fraction takes the next."""
    b = iat_bin(F.col(ms))
    mid = F.when(b >= 300, F.lit(1000.0)).otherwise((bin_edge(b) + bin_edge(b + 1)) / 2)
    r = _ranked(packets.withColumn("__mid", mid), key, "__mid")
    out = []
    for name, q in (("q1", 0.25), ("med", 0.5), ("q3", 0.75)):
        pos = (F.col("n") - 1) * q + 1
        whole = F.floor(pos) == pos
        low = _at(F.when(whole, pos).otherwise(F.ceil(pos)))
        high = _at(F.when(whole, pos + 1).otherwise(F.ceil(pos)))
        out.append(F.round((low + high) / 2, 4).alias(name))
    return r.groupBy(*key).agg(*out)


def band_stats(packets: DataFrame, key: Sequence[str], size: str, low: int, high: int) -> DataFrame:
    """Packets of each key, and number, least, largest and mean size of those within ``low`` to ``high``; zeros where there is none."""
    inside = F.when(F.col(size).between(low, high), F.col(size))
    return packets.groupBy(*key).agg(F.count("*").alias("pkts"), F.count(inside).alias("counted"), *(F.coalesce(f(inside), F.lit(0)).alias(n) for n, f in (("min", F.min), ("max", F.max))), F.round(F.coalesce(F.avg(inside), F.lit(0.0)), 4).alias("mean"))
