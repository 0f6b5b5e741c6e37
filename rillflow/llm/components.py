"""Connected components as joins and groupings (alternating large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import keep


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _least(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, ``(k, m)``.

    The key is written as a new expression, so that a join on it deals both sides anew and Spark may split
    the edges of a hot node, which it can't where a grouping has dealt them.
    """
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("k"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.where("b > a").join(_least(both), F.col("a") == F.col("k"))
    return joined.select(F.col("b").alias("a"), F.least("k", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = down.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)`` for every node of an edge, root being the smallest node that can be reached.

    Each round is a few equi-joins whose sides Spark may split when a node is hot, and ends in a table in
    the shared folder. Nothing but a count and a checksum comes to the driver. Rounds grow with the
    logarithm of the longest chain. Null ends and self-loops are ignored; no edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _fingerprint(edges)
    while before[0]:
        edges = keep(_small_star(_large_star(edges)), "edges")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
