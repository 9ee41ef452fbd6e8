"""Rows are shuffled for the permutation importance without a pass of all of them through the driver."""

from pyspark.sql import functions as F

from gridpace.plans.learning import shuffled


def test_repeats_are_not_broadcast(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 40).alias("race_no"), (F.col("id") % 7).alias("drv"), F.col("id").alias("lap"), F.array(F.col("id").cast("double")).alias("x")).write.parquet(f"{tmp_path}/rows")
    j = shuffled(spark.read.parquet(f"{tmp_path}/rows"), ("race_no", "drv", "lap"), 3, 4)
    assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    got = j.select("repeat", "b", F.col("x")[0].alias("x"), F.col("z")[0].alias("z")).toPandas()
    assert len(got) == 6000
    for _, g in got.groupby(["repeat", "b"]):
        assert sorted(g.x) == sorted(g.z) and (g.x != g.z).mean() > 0.9
