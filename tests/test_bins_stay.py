"""Weighted quantiles count bins where the values lie: no shuffle of single values before the bins are chosen."""

from pyspark.sql import functions as F

from gridpace.operators import quantile


def test_values_are_not_shuffled_to_be_counted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quantile, "_binned", lambda vc, *a, **k: seen.append(vc) or vc)
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("v"), F.lit(2).alias("w"))
    quantile.group_quantile(df, ["k"], F.col("v"), 0.5, "x", weight=F.col("w"))
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
