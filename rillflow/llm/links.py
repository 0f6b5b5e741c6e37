"""Comparing rows that share a key: sorted partitions are read as a stream, and each run of one key is compared with itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Chunks of the input, sorted by ``keys``, that end where a run of equal keys ends; only the open run is carried over."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            last = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
            b = b.slice(last)
        held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def bounds(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def pairs_of_short_runs(keys: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within runs of at most ``longest`` rows, one array for each distance."""
    b = bounds(keys)
    short = np.repeat(np.diff(b) <= longest, np.diff(b))
    for d in range(1, longest):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & short[d:])
        if not len(i):
            return
        yield i, i + d


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each node's component, for edges (i, j) among ``n`` nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, hop := root[root]):
            root = hop
        if np.array_equal(root, before):
            return root


def blocks(start: int, end: int, size: int) -> Iterator[tuple[int, int, int, int]]:
    for a in range(start, end, size):
        for c in range(a, end, size):
            yield a, min(a + size, end), c, min(c + size, end)


def spanning(start: int, end: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the linked pairs of one long run connect; each block's pairs are folded into a forest before the next block."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, c, d in blocks(start, end, size):
        i, j = np.nonzero(near(np.arange(a, b), np.arange(c, d)))
        nodes = np.arange(a, b) if a == c else np.concatenate([np.arange(a, b), np.arange(c, d)])
        root = forest(i, j if a == c else j + b - a, len(nodes))
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        left.append(nodes[moved])
        right.append(nodes[root[moved]])
    return np.concatenate(left), np.concatenate(right)


def linked(start: int, end: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs i < j of one long run, compared block by block; ``near`` gives a boolean matrix."""
    found = []
    for a, b, c, d in blocks(start, end, size):
        i, j = np.nonzero(near(np.arange(a, b), np.arange(c, d)))
        i, j = i + a, j + c
        found.append(np.stack([i, j])[:, i < j])
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]
