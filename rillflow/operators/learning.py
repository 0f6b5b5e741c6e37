"""Anomaly labels and simple classifiers over flow features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Distances that a task holds at once.
CELLS = 1 << 20


def anomaly_label(hex_text: Column, least: int = 4) -> Column:
    """1 where the anomaly bitfield, written as ``0x...``, is above ``least``."""
    return (F.conv(F.substring(hex_text, 3, 16), 16, 10).cast("long") > least).cast("int")


def _block(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """Ids, vectors and labels, if there are any, of a block, by id."""
    ids, vectors, *labels = rows.flatten()
    if vectors.null_count or len(vectors.value_lengths().unique()) > 1:
        raise ValueError("vectors are null or of several lengths")
    i = ids.to_numpy(zero_copy_only=False)
    order = np.argsort(i, kind="stable")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(i), -1)
    return i[order], v[order], labels[0].take(pa.array(order)) if labels else None


def nearest_labels(rows: DataFrame, queries: DataFrame, k: int, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = 4096) -> DataFrame:
    """The majority label of the ``k`` nearest rows (Euclidean, itself excluded; of equally frequent labels the smallest).

    The stated queries are compared with all rows in blocks: queries are dealt to blocks of bounded size,
    each block meets each block of rows once, and only its k best of that block go on. A task reads the blocks as
    they lie in a batch, a pair at a time, and holds ``CELLS`` distances at most.
    """
    n = max(1, -(-queries.count() // block))
    asked = queries.select(F.pmod(F.xxhash64(row_id), F.lit(n)).alias("b"), F.struct(F.col(row_id).alias("i"), F.col(vector).alias("v")).alias("q"))
    asked = asked.groupBy("b").agg(F.collect_list("q").alias("qs"))  # bounded by the block

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, qs in zip(batch.column("xs"), batch.column("qs"), strict=True):  # a pair of blocks at a time, as it lies in the batch
                xi, xv, y = _block(xs.values)
                ids, vectors, _ = _block(qs.values)
                step = max(1, CELLS // len(xi))
                for at in range(0, len(ids), step):
                    qi, qv = ids[at : at + step], vectors[at : at + step]
                    d = (qv**2).sum(1)[:, None] - 2 * qv @ xv.T + (xv**2).sum(1)[None, :]
                    d = np.round(np.where(qi[:, None] == xi[None, :], np.inf, d), 9)
                    last = np.partition(d, min(k, len(xi)) - 1, axis=1)[:, min(k, len(xi)) - 1][:, None]
                    tie = d == last  # of these the smallest ids go on
                    i, j = np.nonzero((d < last) | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - (d < last).sum(axis=1)[:, None])))
                    yield pa.RecordBatch.from_arrays([pa.array(qi[i], pa.int64()), pa.array(xi[j], pa.int64()), y.take(pa.array(j)).cast(pa.int32()), pa.array(d[i, j])], names=["q", "x", "y", "d"])

    parts = rows.select(F.struct(F.col(row_id).alias("i"), F.col(vector).alias("v"), F.col(label).alias("y")).alias("x"), F.floor(F.monotonically_increasing_id() / block).alias("p"))
    parts = parts.groupBy("p").agg(F.collect_list("x").alias("xs"))  # bounded by the block
    found = parts.crossJoin(asked).select("xs", "qs").mapInArrow(best, "q long, x long, y int, d double").where("d < double('infinity')")
    top = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "x"))).where(F.col("r") <= k)
    votes = top.groupBy("q", "y").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.max_by("y", F.struct(F.col("n"), -F.col("y"))).alias("predicted")).withColumnRenamed("q", row_id)


def confusion(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    return predicted.groupBy(label, prediction).agg(F.count("*").alias("n"))


def clusters(rows: DataFrame, vector: str, k: int = 2, seed: int = 101) -> DataFrame:
    """K-means clusters of the rows."""
    x = rows.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(x).transform(x).drop("__v")


def missing(rows: DataFrame) -> DataFrame:
    """Nulls per column."""
    sums = rows.agg(*(F.sum(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in rows.columns))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("nulls")) for c in rows.columns))).alias("x")).select("x.*")


def split(rows: DataFrame, key: str, test: float = 0.2) -> DataFrame:
    """Each row with its part, ``train`` or ``test``, by a digest of its key: the same however the rows are dealt, and rows of one key together."""
    share = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("part", F.when(share < int(test * 2**32), "test").otherwise("train"))
