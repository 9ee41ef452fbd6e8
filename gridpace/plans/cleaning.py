"""Projection, filter, predicate and cleaning queries (P)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpace.constants import CIRCUIT_ALIASES, DEV_YEARS, TEST_YEARS, TRAIN_YEARS
from gridpace.functions.expr import (alias_name, big, duration_seconds, finished, race_quarter, rnd, status_bucket)
from gridpace.operators.features import status_flags
from gridpace.plans.sqltext import feat_sql, laps_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query

KEY = ["race_no", "drv", "lap"]


@query("p_01_duration_seconds", laps_sql("""
select race_no, drv, lap, round(lap_us / 1000000.0::double, 6) as seconds from laps"""))
def duration(c):
    # landed files hold durations as text, so write the clock as text and read it back
    sec = F.col("lap_us") / F.lit(1e6)
    text = F.format_string("0 days %02d:%02d:%s", F.floor(sec / 3600), F.floor(sec / 60) % 60,
                           F.format_string("%09.6f", F.expr("(lap_us % 60000000) / 1e6D")))
    return c.raw_laps.withColumn("d", text).select(*KEY, F.round(duration_seconds(F.col("d")), 6).alias("seconds"))


@query("p_02_name_aliases", """
with v as (select s_suppkey, case s_suppkey % 5 when 0 then 'Monte Carlo' when 1 then 'Miami Gardens' when 2 then 'Yas Marina'
           when 3 then 'Monaco' else s_name end as location from supplier)
select s_suppkey, case location when 'Monte Carlo' then 'Monaco' when 'Miami Gardens' then 'Miami' when 'Yas Marina' then 'Yas Island'
       else location end as circuit, case when location in ('Monaco', 'Monte Carlo') then 'Monaco' when location in ('Miami', 'Miami Gardens')
       then 'Miami' else location end as loc_key from v""")
def aliases(c):
    loc = F.expr("""case s_suppkey % 5 when 0 then 'Monte Carlo' when 1 then 'Miami Gardens' when 2 then 'Yas Marina'
                    when 3 then 'Monaco' else s_name end""")
    v = c.table("supplier").select("s_suppkey", loc.alias("location"))
    # an equivalence class maps to its alphabetically first spelling
    classes = {name: min(k, a) for k, a in list(CIRCUIT_ALIASES.items())[:2] for name in (k, a)}
    return v.select("s_suppkey", alias_name(F.col("location"), CIRCUIT_ALIASES).alias("circuit"),
                    alias_name(F.col("location"), classes).alias("loc_key"))


@query("p_03_status_flags", laps_sql("""
select race_no, drv, lap, regexp_full_match(track_status, '1+') as green, contains(track_status, '4') as sc,
  regexp_matches(track_status, '[67]') and not contains(track_status, '4') as vsc, contains(track_status, '5') as red from laps"""))
def flags(c):
    return c.raw_laps.select(*KEY, *[e.alias(n) for n, e in status_flags(F.col("track_status")).items()])


@query("p_04_status_bucket", laps_sql("""
select race_no, case when contains(track_status, '5') then 'red' when regexp_matches(track_status, '[2467]') then 'yellow' else 'green' end as bucket,
  count(*) as laps from laps group by all"""))
def bucket(c):
    return c.raw_laps.groupBy("race_no", status_bucket(F.col("track_status")).alias("bucket")).agg(F.count(F.lit(1)).alias("laps"))


@query("p_05_pit_flags", laps_sql("""
select race_no, drv, lap, pit_in is not null and pit_in as pit_in, pit_out and lap > 1 as pit_out, coalesce(deleted, false) as deleted
from laps where pit_in or pit_out or deleted"""))
def pit_flags(c):
    return (c.raw_laps.select(*KEY, F.coalesce("pit_in", F.lit(False)).alias("pit_in"),
                              (F.col("pit_out") & (F.col("lap") > 1)).alias("pit_out"),
                              F.coalesce("deleted", F.lit(False)).alias("deleted"))
            .filter("pit_in or pit_out or deleted"))


@query("p_06_tyre_age", feat_sql("""
select race_no, drv, lap, cast(greatest(coalesce(case when cents % 11 = 0 then null else tyre_life end, lap_in_stint), 1) as bigint) as age from f"""))
def tyre_age(c):
    observed = F.when(F.col("cents") % 11 != 0, F.col("tyre_life"))  # every 11th value is missing
    return c.laps.select(*KEY, big(F.greatest(F.coalesce(observed, "lap_in_stint"), F.lit(1))).alias("age"))


@query("p_07_fuel_and_fraction", feat_sql(f"""
select race_no, drv, lap, {R('fuel_kg')} as fuel_kg, {R('lap_frac')} as lap_frac, laps_left from f"""))
def fuel(c):
    return c.laps.select(*KEY, rnd("fuel_kg").alias("fuel_kg"), rnd("lap_frac").alias("lap_frac"), "laps_left")


@query("p_08_temperature_fill", feat_sql(f"""
select race_no, drv, lap, {R('track_temp')} as track_temp, {R('air_temp')} as air_temp, track_temp_raw is null as filled from f"""))
def fill(c):
    return c.laps.select(*KEY, rnd("track_temp").alias("track_temp"), rnd("air_temp").alias("air_temp"),
                         F.col("track_temp_raw").isNull().alias("filled"))


@query("p_09_traffic_flags", feat_sql("""
select race_no, lap, cast(sum(gap1) as bigint) as under_1s, cast(sum(gap2) as bigint) as under_2s,
  count(*) filter (where gap_ahead > 2.0) as clean_air from f group by all"""))
def traffic(c):
    return c.laps.groupBy("race_no", "lap").agg(
        big(F.sum("gap1")).alias("under_1s"), big(F.sum("gap2")).alias("under_2s"),
        F.count_if(F.col("gap_ahead") > 2.0).alias("clean_air"))


@query("p_10_representative_laps", feat_sql(f"""
select race_id, driver, count(*) filter (where rep) as rep_laps, count(*) as laps, {R('max(drv_med)')} as median_lap,
  {R('max(race_ref)')} as race_ref from f group by race_id, driver"""))
def representative_laps(c):
    return c.laps.groupBy("race_id", "driver").agg(
        F.count_if("rep").alias("rep_laps"), F.count(F.lit(1)).alias("laps"),
        rnd(F.max("drv_med")).alias("median_lap"), rnd(F.max("race_ref")).alias("race_ref"))


@query("p_11_dead_columns", laps_sql("""
select 'rainless' as column_name, true as is_dead union all select 'is_accurate', count(distinct is_accurate) <= 1 from laps
union all select 'compound', count(distinct compound) <= 1 from laps union all select 'team', count(distinct team) <= 1 from laps
union all select 'constant_flag', true"""))
def dead_columns(c):
    """Columns holding one value (or none) carry no information; one aggregate profiles them all."""
    cols = ["rainless", "is_accurate", "compound", "team", "constant_flag"]
    df = c.raw_laps.select(F.lit(None).cast("string").alias("rainless"), "is_accurate", "compound", "team", F.lit(1).alias("constant_flag"))
    prof = df.agg(*[(F.min(x).isNull() | (F.min(x) == F.max(x))).alias(x) for x in cols])
    return prof.unpivot([], cols, "column_name", "is_dead")


@query("p_12_drop_deleted_and_null_keys", laps_sql("""
, x as (select *, case when cents % 83 = 0 then null else compound end as comp2 from laps)
select count(*) as before_rows, count(*) filter (where deleted) as deleted_rows,
  count(*) filter (where not deleted and comp2 is null) as null_key_rows, count(*) filter (where not deleted and comp2 is not null) as kept_rows
from x""".strip()))
def drop_deleted(c):
    x = c.raw_laps.withColumn("comp2", F.when(F.col("cents") % 83 != 0, F.col("compound")))
    return x.agg(F.count(F.lit(1)).alias("before_rows"), F.count_if("deleted").alias("deleted_rows"),
                 F.count_if(~F.col("deleted") & F.col("comp2").isNull()).alias("null_key_rows"),
                 F.count_if(~F.col("deleted") & F.col("comp2").isNotNull()).alias("kept_rows"))


@query("p_13_accurate_laps", laps_sql(f"""
select year, count(*) as laps, {R('avg(lap_time)', 4)} as mean_lap from laps where is_accurate group by year"""))
def accurate(c):
    return c.raw_laps.filter("is_accurate").groupBy("year").agg(
        F.count(F.lit(1)).alias("laps"), rnd(F.avg("lap_time"), 4).alias("mean_lap"))


@query("p_14_race_quarter", laps_sql("""
select race_no, cast(greatest(1, ceil(4 * lap / race_laps::double)) as int) as quarter, count(*) as laps from laps group by all"""))
def quarter(c):
    return c.raw_laps.groupBy("race_no", race_quarter(F.col("lap"), F.col("race_laps")).alias("quarter")).agg(F.count(F.lit(1)).alias("laps"))


@query("p_15_race_clock", laps_sql("""
select race_no, drv, lap, round((end_us - min(case when lap = 1 then start_us end) over (partition by race_no)) / 1000000.0::double, 6) as clock from laps"""))
def race_clock(c):
    t0 = c.raw_laps.filter("lap = 1").groupBy("race_no").agg(F.min("start_us").alias("t0"))
    return c.raw_laps.join(t0, "race_no", "left").select(*KEY, F.round((F.col("end_us") - F.col("t0")) / F.lit(1e6), 6).alias("clock"))


@query("p_16_season_split", laps_sql("""
select case when year in (2021, 2022, 2023) then 'train' when year = 2024 then 'dev' else 'test' end as split, count(*) as laps,
  count(distinct race_no) as races from laps group by all"""))
def season_split(c):
    split = F.when(F.col("year").isin(*TRAIN_YEARS), "train").when(F.col("year").isin(*DEV_YEARS), "dev").when(F.col("year").isin(*TEST_YEARS), "test")
    races = c.raw_laps.groupBy("year", "race_no").agg(F.count(F.lit(1)).alias("n"))
    return races.groupBy(split.alias("split")).agg(F.sum("n").alias("laps"), F.count(F.lit(1)).alias("races"))


@query("p_17_circuit_year_split", laps_sql("""
, cy as (select circuit, year, count(*) as laps from laps group by all),
rk as (select *, row_number() over (partition by circuit order by md5(concat('42|', circuit, '|', year)), year) as k, count(*) over (partition by circuit) as n from cy)
select circuit, year, laps, case
  when n >= 5 then case when k <= floor(n * 0.6) then 'train' when k <= floor(n * 0.6) + floor(n * 0.2) then 'dev' else 'test' end
  when n >= 3 then case when k <= n - 2 then 'train' when k = n - 1 then 'dev' else 'test' end else 'train' end as split from rk""".strip()))
def circuit_year_split(c):
    cy = c.raw_laps.groupBy("circuit", "year").agg(F.count(F.lit(1)).alias("laps"))
    w = Window.partitionBy("circuit")
    rk = (cy.withColumn("k", F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("42|"), "circuit", F.lit("|"), F.col("year").cast("string"))), "year")))
          .withColumn("n", F.count(F.lit(1)).over(w)))
    split = F.expr("""case when n >= 5 then case when k <= floor(n * 0.6D) then 'train' when k <= floor(n * 0.6D) + floor(n * 0.2D) then 'dev' else 'test' end
        when n >= 3 then case when k <= n - 2 then 'train' when k = n - 1 then 'dev' else 'test' end else 'train' end""")
    return rk.select("circuit", "year", "laps", split.alias("split"))


@query("p_18_finished_cars", laps_sql("""
select race_no, count(distinct drv) filter (where regexp_matches(finish_status, '^Finished') or starts_with(finish_status, '+')) as finished,
  count(distinct drv) as cars from laps group by race_no"""))
def finished_cars(c):
    cars = c.raw_laps.groupBy("race_no", "drv").agg(F.max("finish_status").alias("s"))
    return cars.groupBy("race_no").agg(F.count_if(finished(F.col("s"))).alias("finished"), F.count(F.lit(1)).alias("cars"))


@query("p_19_range_filter", laps_sql("""
select compound, count(*) filter (where lap_time between 85 and 120) as in_range, count(*) filter (where not lap_time between 85 and 120) as out_of_range
from laps group by compound"""))
def range_filter(c):
    ok = F.col("lap_time").between(85, 120)
    return c.raw_laps.groupBy("compound").agg(F.count_if(ok).alias("in_range"), F.count_if(~ok).alias("out_of_range"))


@query("p_20_prefix_lookup", laps_sql("""
, ask as (select distinct lower(substr(p_type, 1, 3)) as ask from part union select 'c7' union select 'c1' union select 'c10'),
known as (select distinct circuit as name from laps union select distinct upper(p_type) from part)
select ask, count(name) as matches, case when count(name) = 1 then max(name) end as resolved
from ask left join known on starts_with(lower(name), ask) group by ask""".strip()))
def prefix_lookup(c):
    """A prefix resolves only when exactly one known name starts with it (case ignored)."""
    types = c.table("part").select("p_type").distinct()
    ask = (types.select(F.lower(F.substring("p_type", 1, 3)).alias("ask"))
           .union(c.spark.createDataFrame([("c7",), ("c1",), ("c10",)], "ask string")).distinct())
    known = c.raw_laps.select(F.col("circuit").alias("name")).union(types.select(F.upper("p_type"))).distinct()
    # every prefix of a name is a key, so the lookup is an equi-join
    keys = known.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")),
                                                      lambda i: F.lower(F.substring(F.col("name"), F.lit(1), i)))).alias("ask"))
    return (ask.join(keys, "ask", "left").groupBy("ask")
            .agg(F.count("name").alias("matches"), F.max("name").alias("m"))
            .select("ask", "matches", F.when(F.col("matches") == 1, F.col("m")).alias("resolved")))
