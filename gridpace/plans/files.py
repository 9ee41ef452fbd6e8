"""Source and sink queries (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridpace.functions.expr import rnd
from gridpace.plans.sqltext import feat_sql, laps_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query
from gridpace.session import stage_path
from gridpace.sources.files import append_aligned, not_loaded, read_circuit_csvs, round_trip, strict_json, write_circuit_csvs

KEY = ["race_no", "drv", "lap"]


def n():
    return F.count(F.lit(1))


@query("s_01_parquet_scan", f"select l_returnflag, count(*) as rows_read, {R('sum(l_quantity)', 2)} as quantity from lineitem group by l_returnflag")
def parquet_scan(c):
    return c.table("lineitem").select("l_returnflag", "l_quantity").groupBy("l_returnflag").agg(n().alias("rows_read"), rnd(F.sum("l_quantity"), 2).alias("quantity"))


def circuit_csvs(c):
    def make():
        laps = c.raw_laps.select(F.col("driver").alias("Driver"), F.col("lap").cast("int").alias("LapNumber"), F.col("lap_time").alias("LapTime"),
                                 F.col("compound").alias("Compound"), F.col("tyre_life").cast("int").alias("TyreLife"), F.col("year").cast("int").alias("year"),
                                 F.when(F.col("year") != 2022, F.col("round_no").cast("string")).otherwise("?").alias("round_number"), "circuit")
        train = laps.filter("year <= 2023").withColumn("circuit", F.lit("train"))
        return write_circuit_csvs(laps.unionByName(train), "circuit", stage_path(c.spark, "circuit-csv"))
    return c.memo("circuit_csvs", make)


@query("s_02_csv_scan_many_files", laps_sql(f"select circuit as location, count(*) as laps, {R('sum(lap_time)', 2)} as total from laps group by circuit"))
def csv_scan(c):
    return read_circuit_csvs(c.spark, circuit_csvs(c)).groupBy("location").agg(n().alias("laps"), rnd(F.sum("LapTime"), 2).alias("total"))


@query("s_03_json_scan", laps_sql("""
select race_no, driver, max(lap) as laps, count(*) filter (where pit_in) as stops from laps group by all"""))
def json_scan(c):
    doc = c.raw_laps.groupBy("race_no", "driver").agg(F.struct(F.max("lap").alias("laps"), F.count_if("pit_in").alias("stops")).alias("car"))
    return round_trip(doc, "json", "car-json").select("race_no", "driver", "car.laps", "car.stops")


@query("s_04_concat_frames", laps_sql("select year, count(*) as laps from laps group by year"))
def concat(c):
    """Per-season frames put back together by column name."""
    parts = [c.raw_laps.filter(F.col("year") == y).select("race_no", "year", "lap") for y in range(2021, 2026)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select("lap", "year", "race_no"))
    return out.groupBy("year").agg(n().alias("laps"))


@query("s_05_schema_aligned_append", laps_sql("""
select year, count(*) as laps, count(compound) as with_compound, count(tyre_life) filter (where year <> 2025) as with_life from laps group by year"""))
def aligned(c):
    old = c.raw_laps.filter("year < 2025").select("year", "lap", "compound", "tyre_life")
    new = c.raw_laps.filter("year = 2025").select("compound", "lap", "year", F.col("cents").alias("not_in_header"))
    return append_aligned(old, new).groupBy("year").agg(n().alias("laps"), F.count("compound").alias("with_compound"), F.count("tyre_life").alias("with_life"))


@query("s_06_idempotent_ingest", laps_sql("""
, sched as (select distinct circuit as venue, year, round_no from laps),
loaded as (select *, case when year = 2022 or venue = 'C3' then '?' else cast(round_no as varchar) end as round_text from sched where (round_no + year) % 3 <> 0),
r as (select venue, year, try_cast(round_text as int) as rn from loaded)
select venue, year, round_no from sched s where not exists (select 1 from r where r.venue = s.venue and r.year = s.year and r.rn = s.round_no)
and not exists (select 1 from r where r.venue = s.venue and r.year = s.year group by venue, year having count(rn) = 0)""".strip()))
def ingest(c):
    """Rounds still to load when some are present and some venue-years hold unreadable round numbers."""
    sched = c.raw_laps.select(F.col("circuit").alias("venue"), "year", "round_no").distinct()
    dark = (F.col("year") == 2022) | (F.col("venue") == "C3")
    loaded = sched.filter("(round_no + year) % 3 <> 0").withColumn("round_text", F.when(dark, "?").otherwise(F.col("round_no").cast("string")))
    return not_loaded(sched, loaded).select("venue", "year", "round_no")


@query("s_07_partitioned_parquet_sink", laps_sql(f"select race_no, count(*) as laps, {R('sum(lap_time)', 3)} as total from laps where year = 2024 group by race_no"))
def parquet_sink(c):
    """Written by season; the filter on the season prunes folders."""
    t = c.memo("sink_parquet", lambda: round_trip(c.raw_laps.select("race_no", "lap_time", "year").hint("rebalance", "year"), "parquet", "laps-by-year", "year"))
    return t.filter("year = 2024").groupBy("race_no").agg(n().alias("laps"), rnd(F.sum("lap_time"), 3).alias("total"))


@query("s_08_csv_sink", laps_sql("""
select case when year <= 2023 then 'train' when year = 2024 then 'dev' else 'test' end as split, count(*) as laps, cast(sum(lap) as bigint) as lap_sum from laps group by all"""))
def csv_sink(c):
    t = c.raw_laps.select("lap", "driver", F.expr("case when year <= 2023 then 'train' when year = 2024 then 'dev' else 'test' end").alias("split"))
    return round_trip(t, "csv", "splits-csv", "split", header=True).groupBy("split").agg(n().alias("laps"), F.sum("lap").alias("lap_sum"))


@query("s_09_strict_json_sink", laps_sql(f"""
select race_no, {R('avg(lap_time)', 4)} as mean_lap, cast(null as double) as ratio, count(*) as laps from laps group by race_no"""))
def json_sink(c):
    """NaN and infinite metrics become null, so the document is strict JSON."""
    m = c.raw_laps.groupBy("race_no").agg(rnd(F.avg("lap_time"), 4).alias("mean_lap"), n().alias("laps"))
    bad = F.when(F.col("race_no") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return round_trip(strict_json(m.withColumn("ratio", bad)), "json", "metrics-json", ignoreNullFields=False)


@query("s_10_derived_table_cache", feat_sql("select year, count(*) as laps, count(*) filter (where rep) as rep_laps from f group by year"))
def cache(c):
    """The feature table is written once per session and scanned by every query after that."""
    return c.laps.groupBy("year").agg(n().alias("laps"), F.count_if("rep").alias("rep_laps"))


@query("s_11_coverage_count", laps_sql("select count(*) as total_races from (select distinct circuit, year from laps)"))
def coverage(c):
    """Distinct seasons per file, added up."""
    per_file = read_circuit_csvs(c.spark, circuit_csvs(c)).select("location", "year").distinct().groupBy("location").agg(n().alias("years"))
    return per_file.agg(F.sum("years").alias("total_races"))
