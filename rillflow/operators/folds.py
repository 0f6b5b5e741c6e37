"""Folds over the rows of a key in order, streamed through sorted partitions: no key is ever held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


class Fold:
    """A state for one key: ``add`` takes a row's values and may give rows, ``end`` gives the last ones."""

    def add(self, *values) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def ordered_fold(rows: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], make: Callable[[], Fold], columns: str) -> DataFrame:
    """Rows of ``key`` columns and ``columns`` that a fold gives for each key. One shuffle and one sort on the key."""
    key, values = list(key), list(values)
    names = [*key, *(c.split()[0] for c in columns.split(", "))]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key) + ", " + columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for b in batches:
            out = []
            for k, v in zip(zip(*(b[c].tolist() for c in key), strict=True), zip(*(b[c].tolist() for c in values), strict=True), strict=True):
                if k != now:
                    if fold is not None:
                        out += [(*now, *r) for r in fold.end()]
                    now, fold = k, make()
                out += [(*k, *r) for r in fold.add(*v)]
            yield pd.DataFrame(out, columns=names)
        if fold is not None:
            yield pd.DataFrame([(*now, *r) for r in fold.end()], columns=names)

    used = list(dict.fromkeys([*key, *order, *values]))
    return rows.select(*used).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)
