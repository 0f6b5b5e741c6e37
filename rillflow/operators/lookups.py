"""Lookups: ports, ranges, longest prefixes, black lists, rules of which the first one wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes up to which a dimension is sent to every executor; larger ones are shuffled.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows up to which its bytes are counted at all.
BROADCAST_ROWS = 1_000_000


def fits(dimension: DataFrame, most: int = BROADCAST_BYTES, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a dimension has at most ``rows`` rows and, written out as text with 16 bytes for each row, ``most`` bytes."""
    counted = dimension.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.count("*").alias("rows"), F.sum(F.col("n") + 16).alias("bytes")).first()
    return counted["rows"] <= rows and (counted["bytes"] or 0) <= most


def small(dimension: DataFrame) -> DataFrame:
    """A broadcast hint if the dimension is measured to be small, the plain dimension otherwise."""
    return F.broadcast(dimension) if fits(dimension) else dimension


def first_definition(dimension: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first in order."""
    others = [c for c in dimension.columns if c not in key]
    return dimension.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("__d")).select(*key, *(F.col(f"__d.{c}") for c in others))


def look_up(rows: DataFrame, dimension: DataFrame, on: Sequence[str], label: str, default: str) -> DataFrame:
    """Left equi-join with a default for what isn't there."""
    return rows.join(small(dimension), list(on), "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def range_join(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows with the ranges [low, high) that hold their value.

    Both sides are cut into buckets of ``width`` and joined on them, so Spark hashes where it would compare
    every row with every range. A range that spans many buckets is in each of them.
    """
    last = F.ceil(F.col(high) / width) - 1
    cut = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.greatest(last, F.floor(F.col(low) / width)))))
    keyed = rows.withColumn("__b", F.floor(F.col(value) / width))
    return keyed.join(small(cut), "__b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__b")


def longest_prefix(rows: DataFrame, ip: str, subnets: DataFrame, net: str, prefix: str, label: str, default: str, keep: Sequence[str]) -> DataFrame:
    """The label of the longest subnet that holds an address: an equi-join on every prefix length that occurs, then the longest.

    ``ip`` and ``net`` are IPv4 numbers; ``keep`` identifies a row. At most 33 keys a row, whatever the number of subnets.
    """
    lengths = sorted(r[0] for r in subnets.select(prefix).distinct().limit(34).collect())
    if not lengths:
        return rows.select(*keep, F.lit(default).alias(label))
    mask = lambda n: F.lit(0xFFFFFFFF << (32 - n) & 0xFFFFFFFF)
    return _resolved(rows, ip, {n: F.col(ip).bitwiseAND(mask(n)) for n in lengths}, subnets.select(F.col(net).alias("__n"), F.col(prefix).alias("__p"), F.col(label)), label, default, keep)


def _resolved(rows: DataFrame, address: str, keys: dict[int, Column], nets: DataFrame, label: str, default: str, keep: Sequence[str]) -> DataFrame:
    """Each distinct address is looked up once at every length of ``nets(__n, __p, label)``; rows then take its label."""
    tried = F.explode(F.array(*(F.struct(F.lit(n).alias("__p"), k.alias("__n")) for n, k in keys.items())))
    cut = rows.select(address).where(F.col(address).isNotNull()).distinct().select(F.col(address).alias("__a"), tried.alias("__k")).select("__a", "__k.*")
    found = cut.join(small(nets), ["__n", "__p"]).groupBy("__a").agg(F.max_by(label, "__p").alias("__label"))
    return rows.select(*keep, F.col(address).alias("__own")).join(small(found), F.col("__own") == F.col("__a"), "left").select(*keep, F.coalesce("__label", F.lit(default)).alias(label))


def longest_prefix_hex(rows: DataFrame, address: str, subnets: DataFrame, net: str, bits: str, label: str, default: str, keep: Sequence[str]) -> DataFrame:
    """The same for addresses of any length as hexadecimal digits (IPv6 subnets and their places, makers of MAC addresses).

    A prefix may end within a digit; the rest of that digit and all after it are then 0. At most 129 keys for each distinct address.
    """

    def cut(digits: Column, n: int) -> Column:
        whole, rest = divmod(n, 4)
        if not rest:
            return F.substring(digits, 1, whole)
        digit = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int").bitwiseAND(0xF << (4 - rest) & 0xF)
        return F.concat(F.substring(digits, 1, whole), F.lower(F.conv(digit.cast("string"), 10, 16)))

    lengths = sorted(r[0] for r in subnets.select(bits).distinct().limit(129).collect())
    if not lengths:
        return rows.select(*keep, F.lit(default).alias(label))
    known = F.coalesce(*(F.when(F.col(bits) == n, cut(F.lower(net), n)) for n in lengths))
    nets = subnets.select(known.alias("__n"), F.col(bits).alias("__p"), F.col(label))
    return _resolved(rows, address, {n: cut(F.lower(address), n) for n in lengths}, nets, label, default, keep)


def listed(rows: DataFrame, names: DataFrame, on: str, present: bool = True) -> DataFrame:
    """Rows on the list, or not on it (semi and anti join)."""
    return rows.join(names.select(on).distinct(), on, "left_semi" if present else "left_anti")


def first_rule(rows: DataFrame, rules: DataFrame, condition: Column, rule_no: str, label: str, keep: Sequence[str]) -> DataFrame:
    """The first rule that a row meets, null if none. Rules are compared with every row, so a set that can't be sent to every executor is refused."""
    if not fits(rules):
        raise ValueError("too many rules to compare each with every row")
    met = rows.join(F.broadcast(rules), condition, "left")
    return met.groupBy(*keep).agg(F.min_by(label, rule_no).alias(label))


def regex_rules(rows: DataFrame, text: str, rules: Sequence[tuple[int, str, str, int]], keep: Sequence[str]) -> DataFrame:
    """Hits among ``(number, pattern, class, severity)`` rules, and class and severity of the gravest (of equal ones the first)."""
    met = F.filter(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(-i).alias("order"), F.lit(c).alias("class"))) for i, p, c, s in rules)), lambda x: x.isNotNull())
    top = F.array_max("__m")
    return rows.withColumn("__m", met).select(*keep, F.size("__m").alias("hits"), top["class"].alias("class"), top["severity"].alias("severity"))


def nonstandard_ports(flows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Flows whose protocol isn't known for their port."""
    return flows.join(small(known.select(*on).distinct()), list(on), "left_anti")


def as_of(rows: DataFrame, other: DataFrame, key: Sequence[str], time: str, value: str, keep: Sequence[str]) -> DataFrame:
    """The last ``value`` of ``other`` at or before each row's time: one union and one window, no range join."""
    left = rows.select(*key, time, F.lit(1).alias("__side"), F.struct(*keep).alias("__row"), F.lit(None).cast(other.schema[value].dataType).alias("__v"))
    right = other.select(*key, time, F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(*key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", value)


def interval_links(rows: DataFrame, time: str, flows: DataFrame, first: str, last: str, on: Sequence[str]) -> DataFrame:
    """Rows with the flows of the same endpoint that were open at their time (parent flows)."""
    return rows.join(flows, list(on)).where(F.col(time).between(F.col(first), F.col(last)))
