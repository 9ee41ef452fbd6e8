"""Sums of small arrays by key, built in map tasks and merged in a tree.

Laps never travel: every task folds its rows into one small array per key, and
the partial arrays are added in two rounds (salted, then by key). Each round
streams sorted partials, so memory per task is one array whatever the skew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH_KEYS = 4096


def _merge_stream(keys: list[str], arrays: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur, acc, out = None, None, []
        for pdf in batches:
            ks = list(zip(*[pdf[k] for k in keys])) if keys else [()] * len(pdf)
            vs = list(zip(*[pdf[a] for a in arrays]))
            for k, v in zip(ks, vs):
                if k != cur:
                    if cur is not None:
                        out.append((*cur, *acc))
                    cur, acc = k, [np.array(x, dtype=float) for x in v]
                else:
                    for a, x in zip(acc, v):
                        a += x
            if len(out) >= FLUSH_KEYS:
                yield pd.DataFrame(out, columns=keys + arrays)
                out = []
        if cur is not None:
            out.append((*cur, *acc))
        if out:
            yield pd.DataFrame(out, columns=keys + arrays)
    return run


def sum_arrays(partials: DataFrame, keys: list[str], arrays: list[str], salts: int = 16) -> DataFrame:
    """Add equal-length array columns by key: a salted round first, then one by key."""
    schema = partials.select(*keys, *arrays).schema
    salted = partials.select(*keys, *arrays, (F.spark_partition_id() % salts).alias("_salt"))
    sort = keys + ["_salt"]
    one = (salted.repartition(*[F.col(c) for c in sort]).sortWithinPartitions(*sort)
           .drop("_salt").mapInPandas(_merge_stream(keys, arrays), schema))
    two = one.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys) if keys else one.coalesce(1)
    return two.mapInPandas(_merge_stream(keys, arrays), schema)


def fold_by_key(keys: list[str], fold: Callable[[pd.DataFrame], np.ndarray], name: str):
    """A map task that turns its rows into one summed array per key."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple, np.ndarray] = {}

        def flush():
            return pd.DataFrame([(*k, v) for k, v in acc.items()], columns=keys + [name])
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for k, g in groups:
                k = k if isinstance(k, tuple) else (k,)
                v = fold(g)
                if k in acc:
                    acc[k] += v
                else:
                    acc[k] = v
            if len(acc) > FLUSH_KEYS:
                yield flush()
                acc.clear()
        if acc:
            yield flush()
    return run
