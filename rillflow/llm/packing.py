"""Best-fit packing by sums of squares.

Documents are encoded and cut where they lie; only the pieces' numbers move. Pieces that fill a sequence are
sequences; the others are dealt evenly to shards of tens of thousands, and each goes where the sum over all
residual gaps of the squared count of open sequences with that gap becomes smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.bpe import encoder
from rillflow.llm.common import bounded_batches, id_and_text, keep, tasks_for

#: Pieces that are packed together.
SHARD = 40_000
PIECES_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens; only the first may be shorter than ``capacity``."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document with the CRC-32 of their ids, and a number that deals them evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        ctx = TaskContext.get()
        deal = (ctx.partitionId() if ctx else 0) * 7919
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = memoryview(enc.encode(text) + end)
                for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), deal))
                    deal += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int32() if i == 1 else pa.int64()) for i in range(6)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return id_and_text(bounded_batches(docs)).mapInArrow(run, PIECES_SCHEMA)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bin, offset)`` of each item, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        old = count[s:capacity]  # gaps that hold it
        change = np.where(old > 0, 2 * (count[: capacity - s] - old) + 2, np.iinfo(np.int64).max)
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if len(change) and old[0] > 0:
            change[0] = 1 - 2 * old[0]  # it fills that bin, which leaves no gap
        k = int(change.argmin()) if len(change) else -1
        if k >= 0 and change[k] <= fresh:
            gap = s + k
            b = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, n
            n += 1
        where[i], offset[i] = b, capacity - gap
        if gap > s:
            bins[gap - s].append(b)
            count[gap - s] += 1
    return where, offset


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts have one piece, the end id alone. Repeated rows are packed as often as they occur;
    null ids pass through; an empty table gives no rows; other columns are not read. Longer pieces go first
    within a shard, ties in the order of their ids, so a shard's result doesn't depend on arrival.
    """
    all_pieces = keep(pieces(docs, tokenizer, end_id, capacity), "pieces")
    shards = tasks_for(all_pieces.where(F.col("length") < capacity).count(), SHARD)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32", "deal"], ascending=[False, True, True, True, True])
        where, offset = sum_of_squares(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["shard"] + where * shards, offset=offset)[[*cols, "sequence_id", "offset"]]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    short = all_pieces.where(F.col("length") < capacity).withColumn("shard", F.pmod("deal", F.lit(shards))).groupBy("shard").applyInPandas(place, schema)
    full = all_pieces.where(F.col("length") == capacity).select(*cols, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)
