"""Embedding near-dedup with spherical-cap filters.

Filter directions form structured random product codes: the dimensions, after a random rotation, are cut into
parts with random codewords of their own, and every choice of a codeword for each part is a direction. A vector
is list-decoded to all directions whose inner product with it exceeds a threshold; vectors that share a
direction are compared in double precision. The number of codewords grows with the number of vectors, so that
strangers seldom share a direction whatever the table's size; for each dimension and number of codewords the
threshold is the largest at which random pairs at the wanted cosine share a direction of one code often enough
for the independent codes together to reach the wanted recall.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import keep
from rillflow.llm.components import components
from rillflow.llm.links import blocks, bounds, forest, pairs_of_short_runs, runs

#: Independent codes, directions of a code for each vector of the table, and codewords of a part at most (beyond, there are more parts).
CODES, DIRECTIONS, CODEWORDS = 10, 64, 4096
#: Rows of a direction in one task are those of two blocks of about this size, compared so many at once.
BLOCK, STEP = 2048, 512
SHORT = 24
RECALL = 0.98


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class ProductCode:
    """A rotation, and random codewords for each part of ``dim`` dimensions."""

    def __init__(self, dim: int, parts: int, k: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
        self.edges = [round(dim * i / parts) for i in range(parts + 1)]
        self.k = k
        self.words = [_unit(rng.standard_normal((k, b - a))).astype(np.float32).T for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def decode(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """``(row, direction)`` of all directions beyond the threshold, rows ascending: choices that can't reach it any more are left out part by part."""
        x = x.astype(np.float32) @ self.rotation
        scores = [x[:, a:b] @ w for a, b, w in zip(self.edges[:-1], self.edges[1:], self.words, strict=True)]
        best = np.stack([s.max(axis=1) for s in scores])
        row, direction, score = np.arange(len(x)), np.zeros(len(x), np.uint64), np.zeros(len(x), np.float32)
        for p, s in enumerate(scores):
            before, after = best[:p].sum(axis=0), best[p + 1 :].sum(axis=0)
            at, word = np.nonzero(s >= (threshold - before - after)[:, None])
            n = np.bincount(at, minlength=len(x))
            start, n_old = np.cumsum(n) - n, n[row]
            old = np.repeat(np.arange(len(row)), n_old)
            new = np.arange(len(old)) - np.repeat(np.cumsum(n_old) - n_old, n_old) + start[row[old]]
            total = score[old] + s[at[new], word[new]]
            good = total + after[row[old]] >= threshold
            old, new, score = old[good], new[good], total[good]
            row, direction = row[old], direction[old] * np.uint64(self.k) + word[new].astype(np.uint64)
        return row, direction


class Codes:
    """The codes of one dimension for a table of ``n`` vectors, with their threshold."""

    def __init__(self, dim: int, cosine: float, n: int, recall: float = RECALL, seed: int = 20240):
        wanted = DIRECTIONS * max(n, 2)
        parts = next(p for p in range(2, 99) if wanted ** (1 / p) <= CODEWORDS)
        k = int(np.clip(round(wanted ** (1 / parts)), 4, max(4, 2 ** (0.45 * dim / parts))))
        self.codes = [ProductCode(dim, parts, k, seed + i) for i in range(CODES)]
        rng = np.random.default_rng([seed, dim, 1])
        x, y = _unit(rng.standard_normal((1000, dim))), rng.standard_normal((1000, dim))
        y = cosine * x + np.sqrt(1 - cosine**2) * _unit(y - (y * x).sum(1, keepdims=True) * x) if dim > 1 else x
        self.threshold, shared = parts**0.5, 0.0
        while shared < 1 - (1 - recall) ** (1 / CODES):
            self.threshold -= 0.01
            (i, a), (j, b) = (self.codes[0].decode(v, self.threshold) for v in (x, y))
            same = np.intersect1d(a * np.uint64(1024) + i.astype(np.uint64), b * np.uint64(1024) + j.astype(np.uint64))
            shared = len(np.unique(same % np.uint64(1024))) / len(x)
        self.dim = dim

    def decode_all(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, filter)`` for unit vectors, as numbers that tell codes and dimensions apart."""
        rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for first in range(0, len(x), 256):
            for i, code in enumerate(self.codes):
                row, direction = code.decode(x[first : first + 256], self.threshold)
                rows.append(row + first)
                filters.append(_mixed(_mixed(direction) ^ np.uint64(self.dim * CODES + i)))
        return np.concatenate(rows), np.concatenate(filters).view(np.int64)


@lru_cache(maxsize=8)
def code(dim: int, cosine: float, n: int) -> Codes:
    return Codes(dim, cosine, n)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as bytes, scaled by a power of two, in single precision where that loses nothing; and a digest of their values."""
    for b in batches:
        lists = b.column("embedding")
        flat = lists.flatten()
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        value = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
        start = np.cumsum(size) - size
        stored: list[bytes | None] = [None] * len(lists)
        digest: list[bytes | None] = [None] * len(lists)
        for dim in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == dim)
            m = value[start[at][:, None] + np.arange(dim)]
            top = np.abs(m).max(axis=1)
            usable = np.isfinite(top) & (top > 0)
            at, m = at[usable], m[usable] + 0.0
            m = np.ldexp(m, -np.frexp(top[usable])[1][:, None])
            single = m.astype(np.float32)
            fits = (single == m).all(axis=1)
            for i, f, row, short in zip(at, fits, m, single, strict=True):
                digest[i] = hashlib.sha256(row.tobytes()).digest()
                stored[i] = short.tobytes() if f else row.tobytes()
        yield pa.RecordBatch.from_arrays([b.column("row_no"), b.column("vec_id"), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(stored, pa.binary())], names=["row_no", "vec_id", "digest", "dim", "v"])


def _units(dim: np.ndarray, stored: list[bytes], width: int) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to ``width``."""
    out = np.zeros((len(stored), width))
    single = np.array([len(s) for s in stored], np.int64) == 4 * dim
    for d in np.unique(dim).tolist():
        for kind, of_kind in ((np.float32, single), (np.float64, ~single)):
            at = np.flatnonzero((dim == d) & of_kind)
            out[at, :d] = np.frombuffer(b"".join([stored[i] for i in at]), kind).reshape(-1, d)
    return _unit(out)


def _filters(cosine: float, sizes: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, dims, stored = b.column("node").to_numpy(), b.column("dim").to_numpy(), b.column("v").to_pylist()
            for dim in np.unique(dims).tolist():
                if sizes[dim] > 1:
                    at = np.flatnonzero(dims == dim)
                    row, found = code(dim, cosine, sizes[dim]).decode_all(_units(dims[at], [stored[i] for i in at], dim))
                    yield pa.RecordBatch.from_arrays([pa.array(node[at][row]), pa.array(found)], names=["node", "filter"])

    return run


def _smallest_shared(filters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest filter of rows i and j, which share one: in merged order, the first that is followed by itself."""
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 4096):
        both = np.sort(np.concatenate([filters[i[a : a + 4096]], filters[j[a : a + 4096]]], axis=1), axis=1)
        out[a : a + 4096] = both[np.arange(len(both)), (both[:, 1:] == both[:, :-1]).argmax(axis=1)]
    return out


def _common_bits(filters: np.ndarray, now: int) -> np.ndarray:
    """A word for each row with a bit for each of the 64 commonest filters below ``now``: rows with a bit in common share one of these."""
    row, column = np.nonzero(filters < now)
    values, at, times = np.unique(filters[row, column], return_inverse=True, return_counts=True)
    rank = np.full(len(values), 64)
    top = np.argsort(-times, kind="stable")[:64]
    rank[top] = np.arange(len(top))
    used = rank[at] < 64
    bits = np.zeros(len(filters), np.uint64)
    np.bitwise_or.at(bits, row[used], np.uint64(1) << rank[at][used].astype(np.uint64))
    return bits


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "filter", "lo", "hi"):
            f, lo, hi, chunk, node, size = (t[c].to_numpy() for c in ("filter", "lo", "hi", "chunk", "node", "size"))
            unit = _units(dims := t["dim"].to_numpy(), t["v"].to_pylist(), int(dims.max()))
            lists = t["filters"].combine_chunks()
            n = lists.value_lengths().to_numpy()
            filters = np.full((len(f), int(n.max())), np.iinfo(np.int64).max)
            filters[np.arange(filters.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
            key = np.concatenate([[0], np.cumsum((f[1:] != f[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))])
            count = np.zeros(len(f), np.int64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

            def take(i: np.ndarray, j: np.ndarray) -> None:
                """Counts linked pairs that have this direction as their first one and lie in this pair of blocks."""
                mine = (dims[i] == dims[j]) & ((lo[i] == hi[i]) | (chunk[i] != chunk[j]))  # noqa: B023
                i, j = i[mine], j[mine]
                mine = _smallest_shared(filters, i, j) == f[i]  # noqa: B023
                i, j = i[mine], j[mine]
                np.add.at(count, i, size[j])  # noqa: B023
                np.add.at(count, j, size[i])  # noqa: B023
                nodes, both = np.unique(np.concatenate([i, j]), return_inverse=True)
                root = forest(both[: len(i)], both[len(i) :], len(nodes))
                moved = np.flatnonzero(root != np.arange(len(nodes)))
                left.append(nodes[moved])  # noqa: B023
                right.append(nodes[root[moved]])  # noqa: B023

            for i, j in pairs_of_short_runs(key, SHORT):
                near = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
                take(i[near], j[near])
            edges = bounds(key)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > SHORT:
                    bits = _common_bits(filters[a:b], f[a])
                    for p, q, r, s in blocks(a, b, STEP):
                        near = (unit[p:q] @ unit[r:s].T >= cosine) & ((bits[p - a : q - a, None] & bits[None, r - a : s - a]) == 0)
                        i, j = np.nonzero(np.triu(near, 1) if p == r else near)
                        take(i + p, j + r)
            root = forest(np.concatenate(left), np.concatenate(right), len(f))
            out = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[root[out]]), pa.array(count[out])], names=["a", "b", "n"])

    return run


def _links(nodes: DataFrame, cosine: float, sizes: dict[int, int]) -> DataFrame:
    """``a, b, n`` for ``nodes(node, size, dim, v)``: n of a's links, and a node b of its component; several rows for one a.

    Only numbers move until it is known which directions several vectors share; then a vector goes to each of those once for each pair of blocks.
    """
    at = keep(nodes.select("node", "dim", "v").mapInArrow(_filters(cosine, sizes), "node long, filter long"), "filters")
    common = at.groupBy("filter").count().where("count > 1")
    # The key is written as a new expression, so that Spark may split a hot direction's rows.
    common = common.select(F.col("filter").bitwiseXOR(F.lit(0).cast("long")).alias("__filter"), F.ceil(F.col("count") / BLOCK).cast("long").alias("parts"))
    shared = at.join(common, F.col("filter") == F.col("__filter")).groupBy("node").agg(F.collect_list(F.struct("filter", "parts")).alias("at"))  # a vector has some tens
    rows = shared.join(nodes.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node")).withColumn("filters", F.col("at.filter"))
    rows = rows.select("node", "size", "dim", "v", "filters", F.inline("at")).withColumn("chunk", F.pmod(F.xxhash64("node"), "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("filter", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "size", "dim", "v", "filters")
    rows = rows.repartition("filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi", "node")
    return rows.mapInArrow(_compare(cosine), "a long, b long, n long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: they have no
    links and are their own component. Vectors of different dimensions never link. Vectors equal up to a power
    of two are one node from the start and count as linked. Repeated or null ids are rows of their own; a
    component's id is its smallest id that isn't null; a row with a null id isn't kept. An empty table gives
    no rows; other columns are not read. The driver learns one count for each dimension that occurs.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = keep(rows.mapInArrow(_prepare, "row_no long, vec_id long, digest binary, dim int, v binary"), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("row_no").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("size"), F.min("dim").alias("dim"))
    classes = keep(classes, "classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().toLocalIterator()}
    nodes = rows.select("row_no", "v").join(classes.select("node", "size", "dim"), F.col("row_no") == F.col("node")).select("node", "size", "dim", "v")
    links = keep(_links(keep(nodes, "nodes"), cosine, sizes), "links")
    roots = components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    found = classes.join(counts, classes["node"] == counts["a"], "left").join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left")
    found = keep(found.select("digest", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "found")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = keep(found.join(least, "root").select(F.col("digest").alias("__digest"), "n_links", "component_id"), "ids")
    out = rows.select("vec_id", "digest").join(ids, F.col("digest") == F.col("__digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
