"""SimHash near-dedup with deletion-variant signatures.

With at most four differing bits and three segments, one segment differs by at most one bit. Each distinct
fingerprint is indexed under every segment with every one of its bits left out; two fingerprints within four
bits share such a key, so an equality join on keys and a comparison of all bits loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import bounded_batches, id_and_text, keep, keep_rows, release
from rillflow.llm.components import components
from rillflow.llm.links import bounds, forest, pairs_of_short_runs, runs, spanning

BITS = 64
#: Runs up to this length are compared by distance, longer ones by blocks, the longest ones by pieces first.
SHORT, LONG = 24, 4096
#: Fingerprints of a key from which it is split into blocks, about so large, with a key of its own for each pair of blocks.
BLOCK = 4096


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits over the XXH64 of every shingle of words; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and space and 09-0D only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, digests: bool = False) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row; whole texts, null counting as empty. ``digests`` adds the text's SHA-256 and ``h``, a hash of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            others = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(fp)], names=[*others, "fp"])

    rows = id_and_text(bounded_batches(docs))
    if digests:
        return rows.select("*", F.sha2("text", 256).alias("digest"), F.xxhash64("doc_id", "text").alias("h")).mapInArrow(run, "doc_id long, digest string, h long, fp long")
    return rows.mapInArrow(run, "doc_id long, fp long")


def segments(differing: int) -> list[tuple[int, int]]:
    """``(first bit, bits)``: as few segments as leave one with at most one of the differing bits."""
    n = differing // 2 + 1
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return list(zip(edges[:-1], np.diff(edges).tolist(), strict=True))


def variants(fp: Column, differing: int) -> Column:
    """An array of keys: the segment's number, the left-out bit, and the segment with that bit cleared."""
    keys = []
    for k, (at, bits) in enumerate(segments(differing)):
        segment = F.shiftrightunsigned(fp, at).bitwiseAND((1 << bits) - 1)
        keys += [segment.bitwiseAND(~(1 << b)) + F.lit(((k * 64 + b) << 45)) for b in range(bits)]
    return F.array(*keys)


def _near(fp: np.ndarray, most: int):
    return lambda a, c: np.bitwise_count(fp[a][:, None] ^ fp[c][None, :]) <= most


def _long_run(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that span a very long run: some of ``most + 1`` pieces is equal, so each piece sorts them into small groups."""
    found = []
    free = np.flatnonzero([np.ptp((fp >> np.uint64(b)) & np.uint64(1)) for b in range(BITS)])  # the shared bits sort nothing
    for piece in np.array_split(free, most + 1):
        mask = np.uint64(sum(1 << int(b) for b in piece))
        order = np.argsort(fp & mask, kind="stable")
        edges = bounds((fp & mask)[order])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                i, j = spanning(a, b, _near(fp[order], most))
                found.append(np.stack([order[i], order[j]]))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _compare(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in runs(batches, "key"):
            key, fp = chunk["key"].to_numpy(), chunk["fp"].to_numpy().view(np.uint64)
            left, right = [], []
            for i, j in pairs_of_short_runs(key, SHORT):
                near = np.bitwise_count(fp[i] ^ fp[j]) <= most
                left.append(i[near])
                right.append(j[near])
            edges = bounds(key)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > SHORT:
                    i, j = spanning(0, b - a, _near(fp[a:b], most)) if b - a <= LONG else _long_run(fp[a:b], most)
                    left.append(i + a)
                    right.append(j + a)
            if left:
                root = forest(np.concatenate(left), np.concatenate(right), len(fp))
                moved = np.flatnonzero(root != np.arange(len(fp)))
                out = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[moved]), pa.array(out[root[moved]])], names=["a", "b"])

    return run


def _hot_keys(nodes: DataFrame, differing: int) -> DataFrame:
    """``key, parts`` for every key that more than ``BLOCK`` fingerprints may share.

    A key's fingerprints hold one of two segments, so one of these is held by more than half a block.
    """
    hot = None
    for k, (at, bits) in enumerate(segments(differing)):
        segment = F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1)
        held = nodes.groupBy(segment.alias("s")).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 2)
        found = held.select(F.explode(F.array(*(F.col("s").bitwiseAND(~(1 << b)) + F.lit((k * 64 + b) << 45) for b in range(bits)))).alias("key"), "n")
        hot = found if hot is None else hot.unionByName(found)
    return hot.groupBy("key").agg(F.ceil((F.sum("n") + BLOCK // 2) / BLOCK).cast("long").alias("parts"))


def _keyed(nodes: DataFrame, differing: int) -> DataFrame:
    """``key, fp``: a hot key's fingerprints are dealt to blocks, and each goes to a key for every pair of its block with another."""
    keys = nodes.select(F.explode(variants(F.col("fp"), differing)).alias("key"), "fp")
    hot = keep(_hot_keys(nodes, differing), "hot")
    if hot.isEmpty():
        return keys
    keys = keys.join(hot.withColumnRenamed("key", "__hot"), F.col("key") == F.col("__hot"), "left").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.xxhash64("key", F.least("block", x), F.greatest("block", x)))
    return keys.select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp")


def _found(rows: DataFrame, differing: int, *least: Column) -> DataFrame:
    """``fp, root`` for every distinct fingerprint of ``rows``, and the aggregates ``least`` over its rows."""
    nodes = keep(rows.groupBy("fp").agg(*least), "nodes")
    edges = _keyed(nodes.select("fp"), differing).repartition("key").sortWithinPartitions("key").mapInArrow(_compare(differing), "a long, b long")
    roots = keep(components(edges), "roots")
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))


def near_groups(docs: DataFrame, differing: int = 4, shingle: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text)``.

    Fingerprints with at most ``differing`` different bits link; ``component_id`` is the smallest id that
    links reach (of ids that are not null; null if there is none). Texts without words, null ones included,
    have fingerprint zero and link like any other. Equal fingerprints are one node from the start, so copies
    cost nothing further; within a key only a spanning forest leaves a task, never all pairs. Repeated rows
    give repeated rows, an empty table none; other columns are not read.
    """
    rows = keep(fingerprints(docs, shingle), "fingerprints")
    found = _found(rows, differing, F.min("doc_id").alias("least"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = keep(found.join(least, "root").select(F.col("fp").alias("__fp"), "component_id"), "classes")
    return rows.join(ids, rows["fp"] == ids["__fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, differing: int = 4, shingle: int = 4) -> DataFrame:
    """One row of each group of ``docs``, the one with the smallest id, with all its columns.

    A row with a null id stays if its group has no other id. Of rows that share the id, or have none, the one
    with the least digest of its text stays, and one of those that share the text too. The texts of rows that
    stay don't move, but for about one in 200.
    """
    rows = keep(fingerprints(docs, shingle, digests=True), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))).alias("first")
    kept = _found(rows, differing, first).groupBy("root").agg(F.min("first").alias("first"))
    kept = keep(kept.select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    rows = rows.join(kept, same, "left").select("doc_id", "digest", "h", F.col("__digest").isNotNull().alias("stays"))
    again = keep(rows.where("stays"), "staying").groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(keep(again, "again"), same, "left").select("doc_id", "digest", "h", "stays", F.coalesce("n", F.lit(1)).alias("n"))
    return keep_rows(docs, rows, F.coalesce(F.col("text"), F.lit("")))
