"""Ordered and capped lists of a flow: first packets, distinct values in order, header chains, wavelets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_packets(packets: DataFrame, key: Sequence[str], columns: Sequence[str], order: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` packets of each key as an ordered array; the cut comes before collecting, so lists stay short."""
    w = Window.partitionBy(*key).orderBy(*order)
    top = packets.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rn", *columns))).alias("first"))


def distinct_in_order(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str], most: int) -> DataFrame:
    """The first ``most`` distinct values of each key in order of appearance, and how many there are."""
    seen = packets.groupBy(*key, column).agg(F.min(F.struct(*order)).alias("at"))
    w = Window.partitionBy(*key).orderBy("at")
    seen = seen.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*key))}).where(F.col("rn") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rn", column))), lambda x: x[column])
    return seen.groupBy(*key).agg(F.array_join(listed, ";").alias("listed"), F.max("n").alias("n_distinct"))


def header_runs(packets: DataFrame, key: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """The header chain of all packets of each key: runs of one header name are counted before they are listed."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.lag(column).over(w) == F.col(column)
    marked = packets.withColumn("__same", same).withColumn("run", F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*key, "run", column).agg(F.count("*").alias("n"))
    text = F.concat(F.col(column), F.when(F.col("n") > 1, F.concat(F.lit("{"), F.col("n").cast("string"), F.lit("}"))).otherwise(F.lit("")))
    return runs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", text.alias("t")))), lambda x: x["t"]), ":").alias("chain"))


def header_chain(headers: Column) -> Column:
    """``eth:vlan{2}:ipv4``: runs of one header name are counted in braces."""
    step = lambda acc, h: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["h"] == h),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(h.alias("h"), (F.try_element_at(acc, F.lit(-1))["n"] + 1).alias("n")))),
    ).otherwise(F.concat(acc, F.array(F.struct(h.alias("h"), F.lit(1).alias("n")))))
    runs = F.aggregate(headers, F.expr("CAST(array() AS array<struct<h:string,n:int>>)"), step)
    return F.array_join(F.transform(runs, lambda r: F.concat(r["h"], F.when(r["n"] > 1, F.concat(F.lit("{"), r["n"].cast("string"), F.lit("}"))).otherwise(F.lit("")))), ":")


def pulses(packets: DataFrame, key: Sequence[str], iat: str, size: str, order: Sequence[str], least: float) -> DataFrame:
    """Packets that follow within ``least`` seconds merged into pulses: packets and bytes of each."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = packets.withColumn("pulse", F.sum(F.when(F.col(iat) >= least, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "pulse").agg(F.count("*").alias("pkts"), F.sum(size).alias("bytes"))


def _low_pass() -> np.ndarray:
    """The six-tap Daubechies filter with three vanishing moments, from its closed form."""
    a, b = np.sqrt(10), np.sqrt(5 + 2 * np.sqrt(10))
    return np.array([1 + a + b, 5 + a + 3 * b, 10 - 2 * a + 2 * b, 10 - 2 * a - 2 * b, 5 + a - 3 * b, 1 + a - b]) / (16 * np.sqrt(2))


def wavelet(values: Sequence[float], levels: int = 3) -> tuple[list[list[float]], list[float]]:
    """Detail coefficients of each level and the last approximation, zeros beyond the ends."""
    low = _low_pass()
    high = low[::-1] * np.array([1, -1] * 3)
    x, details = np.asarray(values, float), []
    for _ in range(levels):
        details.append(np.convolve(x, high)[1::2].tolist())
        x = np.convolve(x, low)[1::2]
    return details, x.tolist()


def flow_wavelets(packets: DataFrame, key: Sequence[str], size: str, order: Sequence[str], least: int = 8, most: int = 40) -> DataFrame:
    """Wavelet coefficients of the lengths of the first ``most`` packets of flows with at least ``least``."""
    first = first_packets(packets, key, [size], order, most).where(F.size("first") >= least)

    def run(batches):
        for pdf in batches:
            done = [wavelet([p[size] for p in f]) for f in pdf["first"]]
            yield pd.DataFrame({k: pdf[k] for k in key}).assign(n=[len(f) for f in pdf["first"]], detail=[d for d, _ in done], approx=[a for _, a in done])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packets.schema if f.name in key)
    return first.mapInPandas(run, f"{schema}, n long, detail array<array<double>>, approx array<double>")
