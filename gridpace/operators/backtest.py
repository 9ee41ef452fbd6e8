"""Rows that models are scored on: naive forecasts and pit-call states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpace.constants import DRY
from gridpace.operators.scan import framed

CAR = ["race_no", "drv"]
KEY = ["race_no", "drv", "lap"]


def checkpoints(ctx, min_obs: int = 3) -> DataFrame:
    """As of each k = 5, 10, ...: the car's last representative lap, mean of its last five, and how many it has."""
    n = ctx.shape.block_laps
    df = ctx.laps.filter("rep").select(*KEY, "rep_no", "lap_time", "race_laps", "stint", F.expr(f"(rep_no - 1) div {n}").alias("blk"))
    df = framed(df, CAR, {"mean_last5": lambda w: F.avg("lap_time").over(w.rowsBetween(-4, 0)), "nxt": lambda w: F.lead("lap").over(w)},
                order="rep_no", before=4, after=1, blk=ctx.blk, block_laps=n)
    lo = F.expr("greatest(5, (lap + 4) div 5 * 5)")
    hi = F.least(F.coalesce(F.col("nxt") - 1, F.col("race_laps") - 2), F.col("race_laps") - 2)
    df = df.withColumn("k", F.explode(F.when(hi >= lo, F.sequence(lo, hi, F.lit(5).cast("bigint")))))
    return df.filter(F.col("rep_no") >= min_obs).select(
        *CAR, "k", F.col("lap_time").alias("last_lap"), "mean_last5", F.col("rep_no").alias("n_obs"), F.col("stint").alias("stint_k"))


def forecast_rows(ctx, *cols: str) -> DataFrame:
    """Every representative lap paired with each earlier checkpoint of its race: the naive forecasts and ``cols``."""
    ks = F.expr("case when least(lap - 1, race_laps - 2) >= 5 then sequence(5L, least(lap - 1, race_laps - 2), 5L) end")
    tgt = ctx.laps.filter("rep").select(*KEY, "year", F.col("lap_time").alias("y"), *cols, F.explode(ks).alias("k"))
    enough = checkpoints(ctx, 1).groupBy("race_no", "k").agg(F.sum("n_obs").alias("race_obs")).filter("race_obs >= 30")
    # races with too few laps are left out of the checkpoints, which are few, so the pairs are shuffled once
    known = checkpoints(ctx).join(enough.drop("race_obs"), ["race_no", "k"], "left_semi")
    return tgt.repartition(ctx.parts, *CAR, "k").join(known, [*CAR, "k"]).withColumn("h", F.col("lap") - F.col("k"))


def with_outcome(ctx, laps: DataFrame) -> DataFrame:
    """Every lap with its real outcome, an age-based score, and whether it is a candidate for a pit call."""
    df = framed(race_partitioned(ctx, laps), CAR, {"next_out": lambda w: F.coalesce(F.lead("pit_out").over(w), F.lit(False))}, after=1, blk=ctx.blk,
                block_laps=ctx.shape.block_laps)
    cand = (F.col("dry_race") & (F.col("lap") >= 2) & (F.col("lap") <= F.col("race_laps") - 1) & ~F.col("pit_out") & ~F.col("red")
            & F.col("compound").isin(*DRY) & ~(F.col("pit_in") & ~F.col("next_out")))
    return (df.withColumn("y", (F.col("pit_in") & F.col("next_out")).cast("int")).withColumn("candidate", cand)
            .withColumn("status", F.when(F.col("sc"), 1).when(F.col("vsc"), 2).otherwise(0))
            .withColumn("p", F.col("age") / (F.col("age") + 20.0)).withColumn("call", (F.col("p") >= 0.5).cast("int")))


def pit_states(ctx) -> DataFrame:
    """One row per mid-stint state: candidates for a pit call, the real outcome, and an age-based score."""
    return with_outcome(ctx, ctx.laps).filter("candidate").drop("candidate")


def race_partitioned(ctx, laps: DataFrame) -> DataFrame:
    """Short races: one shuffle by race that all per-car and per-lap windows then share. A huge race keeps its spread."""
    return laps if ctx.shape.blocked else laps.repartition(ctx.parts, "race_no")
