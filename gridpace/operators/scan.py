"""Ordered scans over lap series that stay bounded when one series is huge.

A lap series is ordered by a dense lap number. When the longest series is
short, the plain window over its keys is used. Otherwise every window also
partitions by ``blk`` (a run of consecutive laps): running aggregates add a
carry-in computed from per-block totals, and bounded frames read a halo of
neighbouring laps copied into the block. Both give the plain window's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridpace.constants import BLOCK_LAPS

UNB = Window.unboundedPreceding


def lap_window(keys: list[str], order: str = "lap", blk: str | None = None) -> WindowSpec:
    return Window.partitionBy(*keys, *([blk] if blk else [])).orderBy(order)


def running(df: DataFrame, keys: list[str], cols: dict[str, tuple[str, Column]], order: str = "lap",
            blk: str | None = None) -> DataFrame:
    """Add running aggregates over all *earlier* rows of the series (current row excluded).

    ``cols`` maps a new name to ``(kind, expression)``; kind is sum, max, min or
    last (latest non-null). Rows with nothing before them get null.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    w = lap_window(keys, order, blk).rowsBetween(UNB, -1)
    out = df.select("*", *[agg[k](e).over(w).alias(n) for n, (k, e) in cols.items()])
    if not blk:
        return out
    total = {"sum": F.sum, "max": F.max, "min": F.min,
             "last": lambda e: F.max_by(e, F.when(e.isNotNull(), F.col(order)))}
    per_block = df.groupBy(*keys, blk).agg(*[total[k](e).alias(n) for n, (k, e) in cols.items()])
    wb = Window.partitionBy(*keys).orderBy(blk).rowsBetween(UNB, -1)
    carry = per_block.select(*keys, blk, *[agg[k](F.col(n)).over(wb).alias(f"_{n}") for n, (k, _) in cols.items()])
    out = out.join(carry, [*keys, blk], "left")
    merge = {
        "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
        "max": F.greatest, "min": F.least, "last": F.coalesce,
    }
    for n, (k, _) in cols.items():
        out = out.withColumn(n, merge[k](F.col(n), F.col(f"_{n}"))).drop(f"_{n}")
    return out


def framed(df: DataFrame, keys: list[str], cols: dict[str, Callable[[WindowSpec], Column]], order: str = "lap",
           before: int = 0, after: int = 0, blk: str | None = None, block_laps: int = BLOCK_LAPS) -> DataFrame:
    """Add window columns whose frames reach at most ``before`` rows back and ``after`` rows ahead."""
    w = lap_window(keys, order, blk)
    if not blk:
        return df.select("*", *[f(w).alias(n) for n, f in cols.items()])
    pos = (F.col(order) - 1) % block_laps
    here = F.struct(F.col(blk).alias("b"), F.lit(False).alias("h"))
    copies = [here]
    if before:
        copies.append(F.when(pos >= block_laps - before, F.struct((F.col(blk) + 1).alias("b"), F.lit(True).alias("h"))))
    if after:
        copies.append(F.when(pos < after, F.struct((F.col(blk) - 1).alias("b"), F.lit(True).alias("h"))))
    rows = (df.withColumn("_c", F.explode(F.filter(F.array(*copies), lambda c: c.isNotNull())))
            .withColumn("_blk", F.col("_c.b")).withColumn("_halo", F.col("_c.h")))
    wb = lap_window(keys, order, "_blk")
    return (rows.select("*", *[f(wb).alias(n) for n, f in cols.items()])
            .filter("not _halo").drop("_c", "_blk", "_halo"))
