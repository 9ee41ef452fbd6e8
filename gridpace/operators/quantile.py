"""Exact, linearly interpolated quantiles of groups of any size.

Small bounded groups use the built-in ``percentile``. For groups that may hold
a large share of the table, a mergeable sketch brackets the wanted rank, only
the rows inside the bracket are ranked, and the rest are merely counted: the
answer is exact and no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpace.session import stage

ACCURACY = 2000       # the sketch's rank error is at most n / ACCURACY
FEW = 10_000  # groups whose bounds are sent to every task; more are shuffled
MARGIN = 4.0 / ACCURACY  # bracket half-width, wider than the sketch error


def group_quantile(df: DataFrame, keys: list[str], value: Column, q: float, out: str,
                   where: Column | None = None, weight: Column | None = None, bounded: bool = False) -> DataFrame:
    """One row per group: keys plus the exact ``q`` quantile of the non-null values (frequency-weighted by ``weight``)."""
    v = value if where is None else F.when(where, value)
    base = df.select(*keys, v.cast("double").alias("_v"),
                     (weight if weight is not None else F.lit(1)).cast("bigint").alias("_n"))
    base = base.filter("_v is not null and _n > 0")
    if bounded:
        return base.groupBy(*keys).agg(F.percentile("_v", F.lit(q), F.col("_n")).alias(out))
    if weight is not None:
        # a weighted sketch does not exist; bins are counted before any shuffle, so values stay where they are until few are left
        return _binned(base, keys, q, out)
    lo, hi = max(q - MARGIN, 0.0), min(q + MARGIN, 1.0)
    st = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [lo, hi], ACCURACY).alias("_b"))
    small = F.col("_cnt") <= 4 * ACCURACY  # few rows: rank them all
    st = (st.withColumn("_lo", F.when(F.lit(lo == 0.0) | small, F.col("_min")).otherwise(F.col("_b")[0]))
          .withColumn("_hi", F.when(F.lit(hi == 1.0) | small, F.col("_max")).otherwise(F.col("_b")[1])))
    j = _join(base, st.select(*keys, "_lo", "_hi"), keys).filter("_v <= _hi")
    # values below the bracket collapse to one counted row per group
    vc = (j.withColumn("_x", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
          .groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n")))
    return _pick(vc, st.select(*keys, "_cnt"), keys, q, out)


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted ``rows`` are few, so that what it is joined to stays where it is."""
    return F.broadcast(df) if rows <= FEW else df


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")


def _pick(vc: DataFrame, cnt: DataFrame, keys: list[str], q: float, out: str) -> DataFrame:
    """From (keys, _x, _n) in value order (null first = everything below), take the two ranks and interpolate."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    r = vc.withColumn("_cum", F.sum("_n").over(w))
    r = _join(r, cnt.withColumn("_p", F.lit(q) * (F.col("_cnt") - 1)), keys)
    covers = lambda pos: (F.col("_cum") - F.col("_n") <= pos) & (F.col("_cum") > pos)
    a = F.max(F.when(covers(F.floor("_p")), F.col("_x"))).alias("_a")
    b = F.max(F.when(covers(F.ceil("_p")), F.col("_x"))).alias("_z")
    g = r.groupBy(*keys).agg(a, b, F.first("_p").alias("_p"))
    return g.select(*keys, (F.col("_a") + (F.col("_z") - F.col("_a")) * (F.col("_p") - F.floor("_p"))).alias(out))


def _leading_bits(v: Column) -> Column:
    """Sign, exponent and six bits of the mantissa of a double as one number that orders like it: an outlier moves no other value's bin.

    Where the logarithm rounds across a power of two, exponent and fraction make up for each other.
    """
    size = F.least(F.abs(v), F.lit(1.7e308))
    e = F.greatest(F.floor(F.log2(F.greatest(size, F.lit(1e-300)))), F.lit(-1000)).cast("bigint")
    b = (e + 1001) * 64 + F.floor((size / F.pow(F.lit(2.0), e.cast("double")) - 1) * 64)
    return F.when(v < 0, -b - 1).otherwise(b)


def _zoom(vc: DataFrame, cnt: DataFrame, keys: list[str], q: float, code: Column) -> DataFrame:
    """Rows (keys, _x, _n) of the bins of ``code`` that hold the wanted ranks; all below them become one counted row with a null _x."""
    c = vc.withColumn("_bin", F.when(F.col("_x").isNotNull(), code))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)  # bins, not rows
    per = c.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_bn")).withColumn("_bc", F.sum("_bn").over(w))
    per = _join(per, cnt.withColumn("_p", F.lit(q) * (F.col("_cnt") - 1)), keys)
    covers = lambda pos: (F.col("_bc") - F.col("_bn") <= pos) & (F.col("_bc") > pos)
    want = per.groupBy(*keys).agg(*[F.max(F.when(covers(f("_p")), F.col("_bin"))).alias(n) for f, n in ((F.floor, "_b0"), (F.ceil, "_b1"))])
    want = stage(want, "wanted-bins")
    near = _join(c, hinted(want, want.count()), keys).filter("_bin is null or _bin <= _b1")
    return near.withColumn("_x", F.when(F.col("_bin") >= F.col("_b0"), F.col("_x"))).groupBy(*keys, "_x").agg(F.sum("_n").alias("_n"))


def _binned(vc: DataFrame, keys: list[str], q: float, out: str, bins: int = 4096) -> DataFrame:
    """Radix selection over counted values: the leading bits choose a bin, equal steps inside it choose a part, and only its values are ranked."""
    cnt = stage(vc.groupBy(*keys).agg(F.sum("_n").alias("_cnt")), "group-sizes")
    return _pick(_narrowed(vc, cnt, keys, q, bins), cnt, keys, q, out)


def _narrowed(vc: DataFrame, cnt: DataFrame, keys: list[str], q: float, bins: int) -> DataFrame:
    # what one bin of leading bits holds is written, so that the steps after it read no more than that
    near = stage(_zoom(vc.withColumnRenamed("_v", "_x"), cnt, keys, q, _leading_bits(F.col("_x"))), "leading-bits")
    edge = near.groupBy(*keys).agg(F.min("_x").alias("_min"), F.max("_x").alias("_max"))
    step = F.when(F.col("_max") > F.col("_min"), F.least(F.floor((F.col("_x") - F.col("_min")) / (F.col("_max") - F.col("_min")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    return _zoom(_join(near, edge, keys), cnt, keys, q, step)
