"""Lap, car and weather tables derived from the star-schema tables.

Times are whole microseconds (``*_us``), so clocks, gaps and orders are exact
whatever order Spark adds them in; the double columns are for arithmetic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpace.constants import BLOCK_LAPS
from gridpace.operators.scan import running

CAR = ["race_no", "drv"]
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


@dataclass(frozen=True)
class LapShape:
    n_races: int
    max_car_laps: int
    block_laps: int
    n_laps: int = 0

    @property
    def blocked(self) -> bool:
        return self.max_car_laps > self.block_laps


def _lines(ctx) -> DataFrame:
    return ctx.table("lineitem").select(
        F.expr("l_orderkey div 250").alias("race_no"), (F.col("l_partkey") % 20).alias("drv"), *LINE_ORDER)


def lap_shape(ctx, block_laps: int | None = None) -> LapShape:
    """One cheap, map-side-combined count: how long is the longest lap series?"""
    n = _lines(ctx).groupBy(*CAR).count()
    r = n.agg(F.max("race_no"), F.max("count"), F.sum("count")).first()
    return LapShape(int(r[0]) + 1, int(r[1]), block_laps or BLOCK_LAPS, int(r[2]))


def _numbered(lines: DataFrame, blocked: bool) -> DataFrame:
    """Number each car's rows 1..n in line order."""
    if not blocked:
        return lines.withColumn("lap", F.row_number().over(Window.partitionBy(*CAR).orderBy(*LINE_ORDER)).cast("bigint"))
    # a heavy car: count rows per (order, line) slice, then number inside the slice and add the offset
    cut = [*CAR, "l_orderkey", "l_linenumber"]
    w = Window.partitionBy(*CAR).orderBy("l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, -1)
    offset = lines.groupBy(*cut).count().select(*cut, F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*cut).orderBy(*LINE_ORDER[2:])
    return (lines.withColumn("_rn", F.row_number().over(inner)).join(offset, cut)
            .withColumn("lap", (F.col("_off") + F.col("_rn")).cast("bigint")).drop("_off", "_rn"))


def lap_view(ctx) -> DataFrame:
    return labelled(bare_laps(ctx))


def bare_laps(ctx) -> DataFrame:
    """The lap view without the columns that follow from others; short races are dealt by race."""
    shape = ctx.shape
    blk = "blk" if shape.blocked else None
    lines = _lines(ctx)
    if shape.blocked:
        cars = lines.groupBy(*CAR).agg(F.count(F.lit(1)).alias("drv_laps")).withColumn(
            "race_laps", F.max("drv_laps").over(Window.partitionBy("race_no")))
        laps = _numbered(lines, True).join(cars, CAR)
    else:
        # every race is small: one shuffle by race serves all the windows below
        laps = (_numbered(lines.repartition(ctx.parts, "race_no"), False)
                .withColumn("drv_laps", F.count(F.lit(1)).over(Window.partitionBy(*CAR)))
                .withColumn("race_laps", F.max("drv_laps").over(Window.partitionBy("race_no"))))
    laps = (laps
            .select(*CAR, "lap", "drv_laps", "race_laps", F.col("l_quantity").alias("qty"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
                    F.expr(f"(lap - 1) div {shape.block_laps}").alias("blk"))
            .withColumn("pit_in", F.expr("qty >= 49 and lap > 1 and lap < drv_laps")))
    laps = running(laps, CAR, {"_stops": ("sum", F.col("pit_in").cast("bigint")),
                               "_last_in": ("max", F.when(F.col("pit_in"), F.col("lap")))}, blk=blk)
    laps = (laps
            .withColumn("pit_out", F.coalesce(F.col("_last_in") == F.col("lap") - 1, F.lit(False)))
            .withColumn("stint", 1 + F.coalesce("_stops", F.lit(0)))
            .withColumn("age", F.col("lap") - F.coalesce("_last_in", F.lit(0)))
            .withColumn("compound", F.expr("""case when race_no % 10 = 9 then 'INTERMEDIATE'
                when (race_no + drv * 7 + stint * 2) % 3 = 0 then 'SOFT'
                when (race_no + drv * 7 + stint * 2) % 3 = 1 then 'MEDIUM' else 'HARD' end"""))
            .withColumn("_h", F.expr("(race_no * 37 + (lap div 4) * 53) % 100"))
            .withColumn("track_status", F.expr("case when _h < 4 then '4' when _h < 7 then '6' when _h < 11 then '12' else '1' end"))
            .withColumn("lap_us", F.expr("""(80000000 + (race_no % 12) * 2000000 + drv * 50000 + 58500 * (race_laps - lap)
                + case compound when 'SOFT' then 90000 * age - 500000 when 'MEDIUM' then 50000 * age
                                when 'HARD' then 30000 * age + 400000 else 9000000 end
                + (cents % 101 - 50) * 6000
                + case when lap = 1 then 6000000 else 0 end + case when pit_in then 8000000 else 0 end
                + case when pit_out then 14000000 else 0 end)
                * case track_status when '4' then 138 when '6' then 130 else 100 end div 100""")))
    laps = running(laps, CAR, {"_before": ("sum", F.col("lap_us"))}, blk=blk)
    laps = laps.withColumn("start_us", F.expr("drv * 300000 + coalesce(_before, 0)")).withColumn(
        "end_us", F.col("start_us") + F.col("lap_us"))
    # at most one row per car on a given lap, so this window is small
    pos = Window.partitionBy("race_no", "lap").orderBy("end_us", "drv")
    return laps.select(*CAR, "race_laps", "drv_laps", "lap", "stint", F.row_number().over(pos).cast("bigint").alias("position"), "lap_us", "start_us", "end_us",
                       "pit_in", "pit_out", "compound", F.col("age").alias("tyre_life"), F.expr("cents % 97 = 0").alias("deleted"), "track_status", "cents", "blk")


# columns of the lap view that follow from the others of the same row
LABELS = {
    "race_id": "concat(2021 + race_no % 5, '_', lpad(cast(race_no div 5 + 1 as string), greatest(3, length(cast(race_no div 5 + 1 as string))), '0'))",
    "round_no": "race_no div 5 + 1", "circuit": "concat('C', race_no % 12)", "driver": "concat('D', drv)", "team": "concat('T', drv div 2)",
    "lap_time": "lap_us / 1e6D", "t_start": "start_us / 1e6D", "t_end": "end_us / 1e6D", "fresh_tyre": "cents % 5 <> 0", "is_accurate": "not (pit_in or pit_out)",
    "finish_status": """case when drv_laps = race_laps then 'Finished'
            when race_laps - drv_laps <= 5 then concat('+', race_laps - drv_laps, ' Laps') else 'Retired' end""",
    "year": "2021 + race_no % 5"}
VIEW = ["race_no", "race_id", "round_no", "circuit", "race_laps", "drv", "driver", "team", "drv_laps", "lap", "stint", "position", "lap_us", "start_us", "end_us", "lap_time",
        "t_start", "t_end", "pit_in", "pit_out", "compound", "tyre_life", "fresh_tyre", "is_accurate", "deleted", "track_status", "finish_status", "cents", "blk", "year"]


def labelled(laps: DataFrame) -> DataFrame:
    """The lap view's columns, then any others."""
    return laps.select(*[F.expr(LABELS[c]).alias(c) if c in LABELS else c for c in VIEW], *[c for c in laps.columns if c not in VIEW])


def weather_view(ctx, dealt: bool = False) -> DataFrame:
    """One reading per (race, instant): the latest event wins where two share a microsecond. ``dealt``: by race, as the laps of short races are."""
    ev = ctx.table("events").select(
        (F.col("event_id") % ctx.shape.n_races).alias("race_no"), "event_id", "value",
        F.expr("timestampdiff(microsecond, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 432").alias("wt_us"))
    if dealt:
        ev = ev.repartition(ctx.parts, "race_no")
    return (ev.groupBy("race_no", "wt_us").agg(F.max_by("value", "event_id").alias("value"))
            .select("race_no", "wt_us", (F.col("wt_us") / F.lit(1e6)).alias("wt"),
                    F.expr("round(25 + value % 20, 2)").alias("track_temp"), F.expr("round(18 + value % 10, 2)").alias("air_temp"),
                    F.lit(False).alias("rainfall")))


# --- the same tables for the SQL engine that checks results ----------------------------------------------------------
LAPS_SQL = """
li as (
  select l_orderkey // 250 as race_no, l_partkey % 20 as drv, l_quantity as qty,
         cast(round(l_extendedprice * 100) as bigint) as cents,
         row_number() over (partition by l_orderkey // 250, l_partkey % 20 order by l_orderkey, l_linenumber, l_partkey,
                            l_suppkey, l_shipdate, l_quantity, l_extendedprice) as lap
  from lineitem),
cars as (
  select race_no, drv, count(*) as drv_laps, max(count(*)) over (partition by race_no) as race_laps from li group by race_no, drv),
l1 as (
  select li.*, drv_laps, race_laps, qty >= 49 and lap > 1 and lap < drv_laps as pit_in from li join cars using (race_no, drv)),
l2 as (
  select *, coalesce(lag(pit_in) over (partition by race_no, drv order by lap), false) as pit_out,
         cast(1 + coalesce(sum(cast(pit_in as int)) over (partition by race_no, drv order by lap
                           rows between unbounded preceding and 1 preceding), 0) as bigint) as stint from l1),
l3 as (
  select *, row_number() over (partition by race_no, drv, stint order by lap) as age,
         case when race_no % 10 = 9 then 'INTERMEDIATE' when (race_no + drv * 7 + stint * 2) % 3 = 0 then 'SOFT'
              when (race_no + drv * 7 + stint * 2) % 3 = 1 then 'MEDIUM' else 'HARD' end as compound,
         (race_no * 37 + (lap // 4) * 53) % 100 as h from l2),
l4 as (
  select *, case when h < 4 then '4' when h < 7 then '6' when h < 11 then '12' else '1' end as track_status from l3),
l5 as (
  select *, cast((80000000 + (race_no % 12) * 2000000 + drv * 50000 + 58500 * (race_laps - lap)
     + case compound when 'SOFT' then 90000 * age - 500000 when 'MEDIUM' then 50000 * age when 'HARD' then 30000 * age + 400000 else 9000000 end
     + (cents % 101 - 50) * 6000 + case when lap = 1 then 6000000 else 0 end + case when pit_in then 8000000 else 0 end
     + case when pit_out then 14000000 else 0 end)
     * case track_status when '4' then 138 when '6' then 130 else 100 end // 100 as bigint) as lap_us from l4),
l6 as (
  select *, cast(drv * 300000 + sum(lap_us) over (partition by race_no, drv order by lap rows unbounded preceding) as bigint) as end_us from l5),
laps as materialized (
  select race_no, concat(2021 + race_no % 5, '_', lpad(cast(race_no // 5 + 1 as varchar), greatest(3, cast(length(cast(race_no // 5 + 1 as varchar)) as int)), '0')) as race_id, race_no // 5 + 1 as round_no,
     concat('C', race_no % 12) as circuit, race_laps, drv, concat('D', drv) as driver, concat('T', drv // 2) as team, drv_laps, lap, stint,
     row_number() over (partition by race_no, lap order by end_us, drv) as position, lap_us, end_us - lap_us as start_us, end_us,
     cast(lap_us as double) / 1000000 as lap_time, cast(end_us - lap_us as double) / 1000000 as t_start, cast(end_us as double) / 1000000 as t_end,
     pit_in, pit_out, compound, age as tyre_life, cents % 5 <> 0 as fresh_tyre, not (pit_in or pit_out) as is_accurate, cents % 97 = 0 as deleted,
     track_status, case when drv_laps = race_laps then 'Finished' when race_laps - drv_laps <= 5 then concat('+', race_laps - drv_laps, ' Laps')
     else 'Retired' end as finish_status, cents, 2021 + race_no % 5 as year from l6)"""

WEATHER_SQL = """
wraw as (
  select event_id % (select max(l_orderkey) // 250 + 1 from lineitem) as race_no, event_id, value,
         (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) // 432 as wt_us from events),
weather as materialized (
  select race_no, wt_us, cast(wt_us as double) / 1000000 as wt, round(25 + arg_max(value, event_id) % 20, 2) as track_temp,
         round(18 + arg_max(value, event_id) % 10, 2) as air_temp, false as rainfall from wraw group by race_no, wt_us)"""
