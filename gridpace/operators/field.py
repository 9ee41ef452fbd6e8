"""Field reference pace per lap, its interpolation over neutralised laps, clean car pace and stint segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpace.operators.quantile import group_quantile
from gridpace.operators.scan import running
from gridpace.session import stage

CAR = ["race_no", "drv"]


def field_pace(ctx, laps: DataFrame | None = None) -> DataFrame:
    """Per (race, lap): median of cars not stopping, and the lap's status by majority."""
    f = ctx.laps if laps is None else laps
    clean = F.when(~F.col("pit_in") & ~F.col("pit_out"), F.col("lap_time"))
    return f.groupBy("race_no", "lap").agg(
        F.percentile(clean, F.lit(0.5)).alias("field_med"),  # one row per car on a lap: a small group
        F.when(F.count_if("sc") > F.count(F.lit(1)) / 2, "S").when(F.count_if("vsc") > F.count(F.lit(1)) / 2, "V").otherwise("G").alias("status"),
        F.first("blk").alias("blk"))


def green_pace(ctx, fp: DataFrame) -> DataFrame:
    """Linear between the green laps on either side, flat where one side has none."""
    green = (F.col("status") == "G") & F.col("field_med").isNotNull() & (F.col("lap") > 1)
    known = F.when(green, F.struct("lap", "field_med"))
    df = fp.withColumn("_neg", -F.col("lap")).withColumn("_nblk", -F.col("blk"))
    df = running(df, ["race_no"], {"_a": ("last", known)}, blk=ctx.blk)
    df = running(df, ["race_no"], {"_b": ("last", known)}, order="_neg", blk="_nblk" if ctx.blk else None)
    mid = F.col("_a.field_med") + (F.col("_b.field_med") - F.col("_a.field_med")) * (F.col("lap") - F.col("_a.lap")) / (F.col("_b.lap") - F.col("_a.lap"))
    med = (F.when(green, F.col("field_med")).when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), mid)
           .otherwise(F.coalesce(F.col("_a.field_med"), F.col("_b.field_med"), F.col("field_med"))))
    return df.withColumn("green_med", med).drop("_a", "_b", "_neg", "_nblk")


def stints_of(laps: DataFrame, blk: str | None = None) -> DataFrame:
    """Stint segments of every car: a new one starts after each pit lap."""
    df = running(laps.select(*CAR, "lap", "pit_in", "compound", "tyre_life", "blk"), CAR, {"_n": ("sum", F.col("pit_in").cast("bigint"))}, blk=blk)
    df = df.withColumn("stint", 1 + F.coalesce("_n", F.lit(0)))
    return df.groupBy(*CAR, "stint").agg(
        F.min("lap").alias("from_lap"), F.max("lap").alias("to_lap"), F.min_by("compound", "lap").alias("compound"),
        F.greatest(F.lit(1), F.min_by("tyre_life", "lap")).alias("start_age"))


def field_table(ctx) -> DataFrame:
    """Field pace, status and interpolated green pace of every (race, lap)."""
    return ctx.memo("field_table", lambda: stage(green_pace(ctx, field_pace(ctx)).drop("blk"), "field-pace"))


def clean_pace(ctx, laps: DataFrame) -> DataFrame:
    """Real laps with pit-lane time removed: an in- or out-lap is capped by the field median plus the car's usual offset.

    Adds ``clean``, the car's ``off`` (median deviation of its representative
    laps from the field), and the field columns of the lap.
    """
    fp = field_table(ctx)
    d = laps.join(fp, ["race_no", "lap"])
    dev = F.when(F.col("rep") & F.col("field_med").isNotNull(), F.col("lap_time") - F.col("field_med"))
    off = group_quantile(d.select(*CAR, dev.alias("dev")), CAR, F.col("dev"), 0.5, "off", bounded=not ctx.shape.blocked)
    d = d.join(off, CAR, "left").withColumn("off", F.coalesce("off", F.lit(0.0)))
    ref = F.coalesce("field_med", "green_med") + F.col("off")
    return d.withColumn("clean", F.when(F.col("lap_time").isNull(), ref).when(F.col("pit_in") | F.col("pit_out"), F.least(F.col("lap_time"), ref))
                        .otherwise(F.col("lap_time")))
