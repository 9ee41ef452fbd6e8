"""Stint limits and circuit constants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpace.constants import DRY


def stint_limits(laps: DataFrame, q: float = 0.95, min_stints: int = 10) -> DataFrame:
    """95th percentile of tyre age at stint end, per compound (``_global``) and per circuit and compound with enough stints.

    Ages are whole laps, so ``percentile`` holds few distinct values however many stints there are.
    """
    end = laps.filter(F.col("dry_race") & F.col("compound").isin(*DRY)).groupBy("race_no", "drv", "stint").agg(
        F.first("circuit").alias("circuit"), F.min_by("compound", "lap").alias("compound"), F.max("age").alias("age"))
    both = end.select(F.explode(F.array("circuit", F.lit("_global"))).alias("circuit"), "compound", "age")
    g = both.groupBy("circuit", "compound").agg(F.percentile("age", F.lit(q)).alias("max_age"), F.count(F.lit(1)).alias("stints"))
    return g.filter((F.col("circuit") == "_global") | (F.col("stints") >= min_stints))


def circuit_constants(laps: DataFrame) -> DataFrame:
    """Last lap scale and race length in (year, round, driver, lap) order, and the median track temperature (readings to 0.01)."""
    last = F.struct("year", "round_no", "driver", "lap")
    return laps.groupBy("circuit").agg(
        F.max_by("l_scale", F.when(F.col("l_scale").isNotNull(), last)).alias("l_scale"),
        F.percentile("track_temp", F.lit(0.5)).alias("track_temp"), F.max_by("race_laps", last).alias("race_laps"))
