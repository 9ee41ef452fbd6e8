"""Systematic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpace.operators.scan import running

CAR = ["race_no", "drv"]


def every_nth(ctx, laps: DataFrame, target: int) -> DataFrame:
    """Every (n // target)-th lap with ``ok`` in (driver, lap) order of each race.

    The ordinal is the car's own count plus the totals of earlier cars, so no
    window spans a race.
    """
    r = running(laps, CAR, {"_i": ("sum", F.col("ok").cast("bigint"))}, blk=ctx.blk).filter("ok")
    cars = laps.groupBy(*CAR).agg(F.count_if("ok").alias("_n"))
    race = Window.partitionBy("race_no")
    cars = cars.withColumn("_off", F.coalesce(F.sum("_n").over(race.orderBy("drv").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "_step", F.greatest(F.lit(1).cast("bigint"), F.floor(F.sum("_n").over(race) / target)))
    j = r.join(cars, CAR)
    return j.filter((F.coalesce("_i", F.lit(0)) + F.col("_off")) % F.col("_step") == 0).select(*CAR, "lap")
