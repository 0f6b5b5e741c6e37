"""Per-flow features of decoded protocols: groupings over parsed fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def echo_ratio(packets: DataFrame, key: Sequence[str], request: Column, reply: Column) -> DataFrame:
    """Replies over requests; minus the replies where nothing was asked; 0 where there is neither."""
    out = packets.groupBy(*key).agg(F.sum(F.when(request, 1).otherwise(0)).alias("requests"), F.sum(F.when(reply, 1).otherwise(0)).alias("replies"))
    return out.withColumn("ratio", F.when(F.col("requests") > 0, F.round(F.col("replies") / F.col("requests"), 6)).otherwise(-F.col("replies").cast("double")))


def type_bits(packets: DataFrame, key: Sequence[str], number: Column, bits: int = 64) -> DataFrame:
    """A bit field of the numbers below ``bits`` that occur, and how many packets have them."""
    bit = F.when(number.between(0, bits - 1), F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int")))
    return packets.groupBy(*key).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("long")).alias("types"), F.count(bit).alias("pkts"))


def matrix(packets: DataFrame, key: Sequence[str], row: Column, column: Column, most: int = 65_535) -> DataFrame:
    """Counts by two numbers (severity and facility), saturating."""
    return packets.groupBy(*key, row.alias("severity"), column.alias("facility")).agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def endpoint_pairs(packets: DataFrame, key: Sequence[str], src: str, dst: str, most: int = 16) -> DataFrame:
    """The most frequent (source, destination) pairs of each key, with their packets: ``src_dst_n`` joined by ``;``."""
    pairs = packets.groupBy(*key, src, dst).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(F.desc("n"), src, dst)
    top = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("_", src, dst, F.col("n").cast("string")).alias("t")))), lambda x: x["t"])
    return top.groupBy(*key).agg(F.array_join(listed, ";").alias("pairs"))


def sequence_misses(packets: DataFrame, key: Sequence[str], sequence: str, order: Sequence[str], modulus: int = 65_536) -> DataFrame:
    """Packets that don't continue a wrapping sequence, and their share of all packets."""
    step = F.pmod(F.col(sequence) - F.lag(sequence).over(Window.partitionBy(*key).orderBy(*order)), F.lit(modulus))
    out = packets.withColumn("__m", F.when(step != 1, 1).otherwise(0)).groupBy(*key).agg(F.sum("__m").alias("missed"), F.count("*").alias("pkts"))
    return out.withColumn("miss_ratio", F.round(F.col("missed") / F.col("pkts"), 6))


def ranges(packets: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Least and largest value of each column (priorities, intervals)."""
    return packets.groupBy(*key).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
