"""Per-lap features and the representative-lap filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridpace.constants import DEFAULT_TRACK_TEMP, DRY, REF_LAP, START_FUEL_KG
from gridpace.operators.asof import asof_join
from gridpace.operators.quantile import group_quantile
from gridpace.operators.scan import running
from gridpace.sources.lapview import weather_view

CAR = ["race_no", "drv"]
WEATHER_BUCKET_US = 1_800_000_000  # half an hour of session clock per window when a race is huge


def status_flags(status: Column) -> dict[str, Column]:
    """Track-status flags of a lap from its concatenated codes; a lap that saw both counts as SC, not VSC."""
    s = F.coalesce(status, F.lit(""))
    sc = s.contains("4")
    return {"green": s.rlike("^1+$"), "sc": sc, "vsc": s.rlike("6|7") & ~sc, "red": s.contains("5")}


def attach_weather(ctx, laps: DataFrame, dealt: bool = False) -> DataFrame:
    """Latest reading at or before the start of each lap; null before the first reading. Laps that are ``dealt`` by race stay where they are."""
    out = asof_join(laps, weather_view(ctx, dealt=True) if dealt else ctx.weather, ["race_no"], "start_us", "wt_us", ["track_temp", "air_temp", "rainfall"],
                    bucket=WEATHER_BUCKET_US if ctx.shape.blocked else None, parts=None if dealt else ctx.parts)
    return (out.withColumnsRenamed({"asof_track_temp": "track_temp_raw", "asof_air_temp": "air_temp_raw"})
            .withColumn("rainfall", F.coalesce("asof_rainfall", F.lit(False))).drop("asof_rainfall"))


def group_stat(ctx, df: DataFrame, keys: list[str], cols: dict[str, tuple[Column, float]]) -> DataFrame:
    """Exact per-group quantiles given to every row of the group, filtered rows or not.

    Short races use a window on the partitioning the plan already has; a huge
    race is aggregated through the sketch-bracketed quantile and joined back.
    """
    if not ctx.shape.blocked:
        w = Window.partitionBy(*keys)
        return df.select("*", *[F.percentile(e, F.lit(q)).over(w).alias(n) for n, (e, q) in cols.items()])
    stats = df.select(*keys).distinct()
    for n, (e, q) in cols.items():
        stats = stats.join(group_quantile(df, keys, e, q, n), keys, "left")
    return df.join(stats, keys, "left")


def representative(df: DataFrame) -> Column:
    """The lap reflects car, driver, tyre and fuel: stage one of the filter."""
    return (F.col("dry_race") & F.col("compound").isin(*DRY) & F.col("green") & ~F.col("pit_in") & ~F.col("pit_out")
            & (F.col("lap") > 1) & ~F.col("deleted") & F.col("lap_time").isNotNull() & ~F.col("rainfall"))


def prepare(ctx, laps: DataFrame, dealt: bool = False) -> DataFrame:
    df = attach_weather(ctx, laps, dealt)
    if "lap_time" not in df.columns:
        df = df.withColumn("lap_time", F.col("lap_us") / F.lit(1e6))
    df = df.withColumns(status_flags(F.col("track_status")))
    df = (df.withColumn("deleted", F.coalesce("deleted", F.lit(False)))
          .withColumn("age", F.greatest(F.coalesce("tyre_life", F.lit(1)), F.lit(1)).cast("bigint"))
          .withColumn("fuel_kg", F.greatest(F.lit(START_FUEL_KG) * (F.col("race_laps") - F.col("lap") + 0.5) / F.col("race_laps"), F.lit(0.0)))
          .withColumn("lap_frac", F.col("lap") / F.col("race_laps"))
          .withColumn("laps_left", F.col("race_laps") - F.col("lap")))

    # per-car running state; ``lap_in_stint`` counts from the last stint start
    seen = {f"_u{i}": ("max", (F.col("compound") == c).cast("int")) for i, c in enumerate(DRY)}
    df = running(df, CAR, {"_sb": ("sum", F.col("pit_in").cast("bigint")), **seen,
                           "_start": ("max", F.when(F.col("pit_in"), F.col("lap")))}, blk=ctx.blk)
    used = sum((F.greatest(F.coalesce(f"_u{i}", F.lit(0)), (F.col("compound") == c).cast("int")) for i, c in enumerate(DRY)), F.lit(0))
    df = (df.withColumn("stops_before", F.coalesce("_sb", F.lit(0)))
          .withColumn("lap_in_stint", F.col("lap") - F.coalesce("_start", F.lit(0)))
          .withColumn("two_compounds", used >= 2).drop("_sb", "_start", "_u0", "_u1", "_u2"))

    # race-level shares and fills
    wet = F.avg(F.col("compound").isin("INTERMEDIATE", "WET").cast("double"))
    if ctx.shape.blocked:
        df = df.join(df.groupBy("race_no").agg((wet < 0.02).alias("dry_race")), "race_no")
    else:
        df = df.withColumn("dry_race", wet.over(Window.partitionBy("race_no")) < 0.02)
    df = group_stat(ctx, df, ["race_no"], {"_mt": (F.col("track_temp_raw"), 0.5), "_ma": (F.col("air_temp_raw"), 0.5)})
    df = (df.withColumn("track_temp", F.coalesce("track_temp_raw", "_mt", F.lit(DEFAULT_TRACK_TEMP)))
          .withColumn("air_temp", F.coalesce("air_temp_raw", "_ma")).drop("_mt", "_ma"))

    # neighbours in crossing order: one small window per (race, lap)
    line = Window.partitionBy("race_no", "lap").orderBy(F.col("end_us").asc_nulls_last(), "drv")
    gap = lambda other, sign: F.coalesce(sign * (F.col("end_us") - other) / F.lit(1e6), F.lit(99.0))
    df = (df.withColumn("gap_ahead", gap(F.lag("end_us").over(line), 1))
          .withColumn("gap_behind", gap(F.lead("end_us").over(line), -1))
          .withColumn("gap1", (F.col("gap_ahead") < 1.0).cast("double"))
          .withColumn("gap2", ((F.col("gap_ahead") >= 1.0) & (F.col("gap_ahead") < 2.0)).cast("double")))

    df = df.withColumn("_ok", representative(df))
    df = group_stat(ctx, df, CAR, {"drv_med": (F.when(F.col("_ok"), F.col("lap_time")), 0.5)})
    df = df.withColumn("rep", F.coalesce(F.col("_ok") & (F.col("lap_time") / F.col("drv_med")).between(0.95, 1.05), F.lit(False)))
    df = group_stat(ctx, df, ["race_no"], {"race_ref": (F.when(F.col("rep"), F.col("lap_time")), 0.5)})
    df = (df.withColumn("l_scale", F.coalesce(F.col("race_ref") / REF_LAP, F.lit(1.0)))
          .withColumnRenamed("_ok", "rep_base"))
    # ordinal among the car's representative laps, for frames over those laps only
    df = running(df, CAR, {"_rn": ("sum", F.col("rep").cast("bigint"))}, blk=ctx.blk)
    return df.withColumn("rep_no", F.when(F.col("rep"), F.coalesce("_rn", F.lit(0)) + 1)).drop("_rn")


FEATURES_SQL = """
f1 as (
  select laps.*, w.track_temp as track_temp_raw, w.air_temp as air_temp_raw, coalesce(w.rainfall, false) as rainfall
  from laps asof left join weather w on laps.race_no = w.race_no and laps.start_us >= w.wt_us),
f2 as (
  select *, regexp_full_match(track_status, '1+') as green, contains(track_status, '4') as sc,
    regexp_matches(track_status, '6|7') and not contains(track_status, '4') as vsc, contains(track_status, '5') as red,
    greatest(coalesce(tyre_life, 1), 1) as age,
    greatest(100.0::double * (race_laps - lap + 0.5::double) / race_laps, 0::double) as fuel_kg,
    cast(lap as double) / race_laps as lap_frac, race_laps - lap as laps_left,
    avg(case when compound in ('INTERMEDIATE', 'WET') then 1.0 else 0.0 end) over (partition by race_no) < 0.02 as dry_race,
    cast(coalesce(sum(cast(pit_in as int)) over (partition by race_no, drv order by lap rows between unbounded preceding and 1 preceding), 0) as bigint) as stops_before,
    row_number() over (partition by race_no, drv, stint order by lap) as lap_in_stint,
    max(cast(compound = 'SOFT' as int)) over c + max(cast(compound = 'MEDIUM' as int)) over c + max(cast(compound = 'HARD' as int)) over c >= 2 as two_compounds,
    coalesce(w_fill(track_temp_raw, median(track_temp_raw) over (partition by race_no)), 35.0) as track_temp,
    w_fill(air_temp_raw, median(air_temp_raw) over (partition by race_no)) as air_temp,
    coalesce(cast(end_us - lag(end_us) over p as double) / 1000000, 99.0) as gap_ahead,
    coalesce(cast(lead(end_us) over p - end_us as double) / 1000000, 99.0) as gap_behind
  from f1 window c as (partition by race_no, drv order by lap rows unbounded preceding), p as (partition by race_no, lap order by end_us, drv)),
f3 as (
  select *, cast(gap_ahead < 1.0 as double) as gap1, cast(gap_ahead >= 1.0 and gap_ahead < 2.0 as double) as gap2,
    dry_race and compound in ('SOFT', 'MEDIUM', 'HARD') and green and not pit_in and not pit_out and lap > 1 and not deleted
      and lap_time is not null and not rainfall as rep_base from f2),
f4 as (
  select *, quantile_cont(case when rep_base then lap_time end, 0.5) over (partition by race_no, drv) as drv_med from f3),
f5 as (
  select *, coalesce(rep_base and lap_time / drv_med between 0.95 and 1.05, false) as rep from f4),
f6 as (
  select *, quantile_cont(case when rep then lap_time end, 0.5) over (partition by race_no) as race_ref from f5),
f as materialized (
  select *, coalesce(race_ref / 90.0::double, 1.0::double) as l_scale from f6)""".replace("w_fill(", "coalesce(")
