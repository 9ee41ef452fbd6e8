"""Exact forecast and classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpace.operators.quantile import group_quantile

NEVER = 1e9  # stands for an infinite error while ranking


def finite_pair(y: Column, p: Column) -> Column:
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return ok(y) & ok(p)


def regression_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """MAE, RMSE, R2, MAPE (non-zero targets) and n over finite pairs, one pass with map-side combine."""
    d = df.filter(finite_pair(F.col(y), F.col(p)))
    e = F.col(y) - F.col(p)
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
                             F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_var"), (F.avg(F.abs(F.try_divide(e, F.col(y)))) * 100).alias("mape"))
    return g.withColumn("r2", F.when(F.col("_var") > 0, 1 - F.col("_sse") / (F.col("_var") * F.col("n")))).drop("_sse", "_var")


def median_abs_error(df: DataFrame, keys: list[str], y: str, p: str, out: str = "median_ae") -> DataFrame:
    d = df.filter(finite_pair(F.col(y), F.col(p)))
    return group_quantile(d, keys, F.abs(F.col(y) - F.col(p)), 0.5, out)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification(df: DataFrame, keys: list[str], y: str = "y", call: str = "call") -> DataFrame:
    """Precision, recall and F1; 0 where the denominator is 0."""
    yy, cc = F.col(y) == 1, F.col(call) == 1
    g = df.groupBy(*keys).agg(F.count_if(yy & cc).alias("tp"), F.count_if(~yy & cc).alias("fp"), F.count_if(yy & ~cc).alias("fn"))
    return g.select(*keys, "tp", "fp", "fn", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def score_steps(df: DataFrame, score: str = "p", y: str = "y", bins: int = 4096, keys: list[str] = ()) -> DataFrame:
    """Distinct scores per key with their positives and negatives and the totals at strictly higher scores.

    Scores (in [0, 1]) are cut into bins; bin totals are summed over the few
    bins, and the ordering inside a bin is a window of its own.
    """
    s = df.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("neg", F.col("n") - F.col("pos")).withColumn("bin", F.floor(F.col("s") * bins))
    per = s.groupBy(*keys, "bin").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    wb = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)  # at most bins + 1 rows
    per = per.select(*keys, "bin", F.coalesce(F.sum("bp").over(wb), F.lit(0)).alias("hp"), F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("hn"))
    w = Window.partitionBy(*keys, "bin").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return (s.withColumn("ip", F.coalesce(F.sum("pos").over(w), F.lit(0))).withColumn("in_", F.coalesce(F.sum("neg").over(w), F.lit(0)))
            .join(F.broadcast(per), [*keys, "bin"])
            .select(*keys, "s", "pos", "neg", (F.col("hp") + F.col("ip")).alias("pos_above"), (F.col("hn") + F.col("in_")).alias("neg_above")))


def ranking_metrics(steps: DataFrame, keys: list[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum over distinct scores)."""
    return steps.groupBy(*keys).agg(
        (F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"),
        (F.sum(F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("pos_above") + F.col("pos") + F.col("neg_above") + F.col("neg")))
         / F.sum("pos")).alias("average_precision"))


def tolerant(df: DataFrame, keys: list[str], k: int, call: str = "call") -> DataFrame:
    """Precision, recall and F1 when a call within k laps of a real stop (same car) counts.

    Each side spreads its laps over the k laps around them, so matching is an equi-join.
    """
    car = [*keys, "race_no", "drv"]
    real = df.filter("y = 1").select(*car, "lap")
    calls = df.filter(F.col(call) == 1).select(*car, "lap")
    near = lambda d: d.withColumn("lap", F.explode(F.sequence(F.col("lap") - k, F.col("lap") + k))).distinct().withColumn("hit", F.lit(1))
    side = lambda d, o, n: d.join(near(o), [*car, "lap"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"n_{n}"), F.coalesce(F.sum("hit"), F.lit(0)).alias(f"hit_{n}"))
    r, c = side(real, calls, "real"), side(calls, real, "call")
    if keys:
        j = r.join(c, keys, "full").na.fill(0)
    else:
        j = r.withColumn("_k", F.lit(0)).join(F.broadcast(c.withColumn("_k", F.lit(0))), "_k").drop("_k")  # one row each
    j = (j.withColumn("precision", F.col("hit_call") / F.greatest("n_call", F.lit(1)))
         .withColumn("recall", F.col("hit_real") / F.greatest("n_real", F.lit(1))))
    return j.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9)))


def first_call_errors(df: DataFrame, keys: list[str], call: str = "call") -> DataFrame:
    """Per stint that ended in a real stop: first call minus the stop; null when the model never called."""
    g = df.groupBy(*keys, "race_no", "drv", "stint").agg(
        F.min(F.when(F.col("y") == 1, F.col("lap"))).alias("real"), F.min(F.when(F.col(call) == 1, F.col("lap"))).alias("first_call"))
    return g.filter("real is not null").withColumn("err", (F.col("first_call") - F.col("real")).cast("double"))


def first_call_summary(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Shares and medians; a median that would be infinite is null. Errors are whole laps, so few distinct values."""
    a = F.coalesce(F.abs("err"), F.lit(NEVER))
    g = errors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stints"), F.avg(F.col("err").isNull().cast("double")).alias("never_called"),
        F.percentile(a, F.lit(0.5)).alias("_m"), F.avg((a <= 2).cast("double")).alias("within_2_laps"),
        F.avg((a <= 5).cast("double")).alias("within_5_laps"), F.percentile("err", F.lit(0.5)).alias("median_signed_laps"))
    return g.withColumn("median_abs_laps", F.when(F.col("_m") < NEVER / 10, F.col("_m"))).drop("_m")


def neutral_metrics(df: DataFrame, keys: list[str], call: str = "call") -> DataFrame:
    """Balanced accuracy and F1 on SC / VSC laps; a missing rate is left out of the mean."""
    n = df.filter("status <> 0")
    yes, no, c = F.col("y") == 1, F.col("y") == 0, F.col(call) == 1
    g = n.groupBy(*keys).agg(
        F.avg(F.when(yes, c.cast("double"))).alias("_tpr"), F.avg(F.when(no, (~c).cast("double"))).alias("_tnr"),
        F.count(F.lit(1)).alias("states"), F.count_if(yes).alias("stops"),
        F.count_if(yes & c).alias("_tp"), F.count_if(no & c).alias("_fp"), F.count_if(yes & ~c).alias("_fn"))
    bal = F.when(F.col("_tpr").isNull(), F.col("_tnr")).when(F.col("_tnr").isNull(), F.col("_tpr")).otherwise((F.col("_tpr") + F.col("_tnr")) / 2)
    return g.select(*keys, "states", "stops", bal.alias("balanced_accuracy"),
                    _ratio(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")).alias("f1_neutral"))


def threshold_table(df: DataFrame, score: str = "p", y: str = "y", keys: list[str] = ()) -> DataFrame:
    """F1 per key at each of the 95 thresholds 0.05, 0.06, ..., from one histogram pass and suffix sums over 95 rows."""
    grid = F.transform(F.sequence(F.lit(0), F.lit(94)), lambda i: F.lit(0.05) + i * F.lit(0.01))
    s = df.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    h = (s.withColumn("i", F.size(F.filter(grid, lambda t: t <= F.col("s"))) - 1)  # -1: below every threshold
         .groupBy(*keys, "i").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")))
    every = h.select(*keys).distinct() if keys else df.sparkSession.range(1)
    h = every.select(*keys, F.explode(F.sequence(F.lit(-1), F.lit(94))).alias("i")).join(F.broadcast(h), [*keys, "i"], "left").na.fill(0, ["pos", "n"])
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*(keys or [F.lit(0)]))
    t = h.select(*keys, "i", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("called"), F.sum("pos").over(full).alias("all_pos"))
    return t.filter("i >= 0").select(*keys, "i", (F.lit(0.05) + F.col("i") * F.lit(0.01)).alias("threshold"), "tp", "called",
                                     _ratio(2 * F.col("tp"), F.col("called") + F.col("all_pos")).alias("f1"))
