"""Scalar-function queries (F)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridpace.functions.expr import finished, hinge, lerp, recency_weight, rnd, status_letter
from gridpace.operators.limits import circuit_constants
from gridpace.operators.neutral import lap_states, neutral_table
from gridpace.plans.aggregates import NEUTRAL_SQL, PIT_TABLE_SQL
from gridpace.plans.decide import WEAR_LAW
from gridpace.plans.sqltext import feat_sql, laps_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query

KEY = ["race_no", "drv", "lap"]
LAW_SQL = "wl(compound, off, slope, late) as (values " + ", ".join(f"('{c}', {a}::double, {b}::double, {x}::double)" for c, a, b, x in WEAR_LAW) + ")"


def law(c):
    return F.broadcast(c.spark.createDataFrame(WEAR_LAW, "compound string, off double, slope double, late double"))  # three rows


@query("f_01_clip_abs_round", laps_sql(f"""
select race_no, drv, lap, {R('least(greatest(lap_time, 85), 110)', 3)} as clipped, {R('abs(lap_time - 95)', 1)} as off95, cast(round_even(cast(lap * 5 as double) / 10, 0) as bigint) as half_even from laps"""))
def clip(c):
    """Clip, absolute value, and rounding half to even as arrays round."""
    t = F.col("lap_time")
    return c.raw_laps.select(*KEY, rnd(F.least(F.greatest(t, F.lit(85.0)), F.lit(110.0)), 3).alias("clipped"), rnd(F.abs(t - 95), 1).alias("off95"),
                             F.bround((F.col("lap") * 5).cast("double") / 10, 0).cast("bigint").alias("half_even"))


@query("f_02_recency_weight", laps_sql(f"""
select race_no, drv, lap, {R('pow(0.5, (max(lap) over (partition by race_no) - lap) / 5.0)', 9)} as w_lap, {R('pow(0.5, 2025 - year)', 9)} as w_year from laps"""))
def recency(c):
    newest = c.raw_laps.groupBy("race_no").agg(F.max("lap").alias("newest"))
    return c.raw_laps.join(newest, "race_no").select(*KEY, rnd(recency_weight(F.col("lap"), F.col("newest"), 5.0), 9).alias("w_lap"),
                                                     rnd(recency_weight(F.col("year"), F.lit(2025), 1.0), 9).alias("w_year"))


@query("f_03_hinge_basis", feat_sql("""
select race_no, drv, lap, cast(greatest(age, 0) as double) as h0, cast(greatest(age - 4, 0) as double) as h1, cast(greatest(age - 10, 0) as double) as h2,
  cast(greatest(age - 18, 0) as double) as h3, cast(greatest(age - 28, 0) as double) as h4, cast(greatest(age - 40, 0) as double) as h5 from f"""))
def basis(c):
    return c.laps.select(*KEY, *[h.alias(f"h{j}") for j, h in enumerate(hinge(F.col("age")))])


@query("f_04_regex_matches", laps_sql("""
select track_status, finish_status, regexp_full_match(track_status, '1+') as full_match, contains(track_status, '2') as has_2,
  regexp_matches(finish_status, '^Finished') or starts_with(finish_status, '+') as classified, count(*) as laps from laps group by all"""))
def regexes(c):
    s = F.col("track_status")
    return c.raw_laps.groupBy("track_status", "finish_status", s.rlike("^1+$").alias("full_match"), s.contains("2").alias("has_2"),
                              finished(F.col("finish_status")).alias("classified")).agg(F.count(F.lit(1)).alias("laps"))


@query("f_05_padded_ids", laps_sql("select distinct race_no, concat(year, '_', case when round_no < 10 then concat('0', round_no) else cast(round_no as varchar) end) as padded from laps"))
def padded(c):
    return c.raw_laps.select("race_no", "year", "round_no").distinct().select("race_no", F.format_string("%d_%02d", "year", "round_no").alias("padded"))


@query("f_06_composite_key", laps_sql("select concat(circuit, '|', compound) as k, split_part(concat(circuit, '|', compound), '|', 2) as compound, count(*) as laps from laps group by all"))
def composite(c):
    g = c.raw_laps.groupBy("circuit", "compound").agg(F.count(F.lit(1)).alias("laps"))
    return g.select(F.concat_ws("|", "circuit", "compound").alias("k"), "compound", "laps")


@query("f_07_date_difference", """
select o_orderkey, abs(date_diff('day', strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d'), timestamp '1998-01-01')) as days from orders""")
def date_difference(c):
    parsed = F.to_date(F.date_format("o_orderdate", "yyyy-MM-dd"), "yyyy-MM-dd")
    return c.table("orders").select("o_orderkey", F.abs(F.date_diff(parsed, F.lit("1998-01-01").cast("date"))).cast("bigint").alias("days"))


@query("f_08_letter_encoding", feat_sql("""
select substr(compound, 1, 1) as tyre, case when sc then 'S' when vsc then 'V' when red then 'R' else 'G' end as status, count(*) as laps from f group by all"""))
def letters(c):
    return c.laps.groupBy(F.substring("compound", 1, 1).alias("tyre"), status_letter(F.col("sc"), F.col("vsc"), F.col("red")).alias("status")).agg(F.count(F.lit(1)).alias("laps"))


@query("f_09_interpolate_at_point", laps_sql(f"""
, b as (select race_no, drv, max(row(lap, lap_time)) filter (where lap <= 20.5) as lo, min(row(lap, lap_time)) filter (where lap > 20.5) as hi from laps group by all)
select race_no, drv, {R('case when lo is null then hi[2] when hi is null then lo[2] else lo[2] + (hi[2] - lo[2]) * (20.5::double - lo[1]) / (hi[1] - lo[1]) end')} as y from b""".strip()))
def interpolate(c):
    """Piecewise-linear value between laps 20 and 21; one aggregate finds the brackets."""
    p = F.struct(F.col("lap").cast("double").alias("x"), F.col("lap_time").alias("y"))
    g = c.raw_laps.groupBy("race_no", "drv").agg(F.max(F.when(F.col("lap") <= 20.5, p)).alias("lo"), F.min(F.when(F.col("lap") > 20.5, p)).alias("hi"))
    return g.select("race_no", "drv", rnd(lerp(F.lit(20.5), F.col("lo.x"), F.col("lo.y"), F.col("hi.x"), F.col("hi.y"))).alias("y"))


@query("f_10_rotation", f"""
select event_id, {R('value * cos(0.7::double) - event_id % 97 * sin(0.7::double)')} as x, {R('value * sin(0.7::double) + event_id % 97 * cos(0.7::double)')} as y,
  {R('sqrt(value * value + (event_id % 97) * (event_id % 97))')} as r, {R('atan2(event_id % 97, value)', 8)} as phi from events""")
def rotation(c):
    x, y = F.col("value"), (F.col("event_id") % 97).cast("double")
    cs, sn = math.cos(0.7), math.sin(0.7)
    return c.table("events").select("event_id", rnd(x * cs - y * sn).alias("x"), rnd(x * sn + y * cs).alias("y"), rnd(F.hypot(x, y)).alias("r"), rnd(F.atan2(y, x), 8).alias("phi"))


@query("f_11_unit_box", laps_sql(f"""
, b as (select race_no, min(lap_time) as x0, max(lap_time) as x1, min(age0) as y0, max(age0) as y1 from (select race_no, lap_time, tyre_life as age0 from laps) group by race_no)
select race_no, drv, lap, {R('(lap_time - x0) / greatest(x1 - x0, y1 - y0)')} as nx, {R('(tyre_life - y0) / greatest(x1 - x0, y1 - y0)')} as ny, {R('(y1 - y0) / (x1 - x0)')} as aspect
from laps join b using (race_no)""".strip()))
def unit_box(c):
    b = c.raw_laps.groupBy("race_no").agg(F.min("lap_time").alias("x0"), F.max("lap_time").alias("x1"), F.min("tyre_life").alias("y0"), F.max("tyre_life").alias("y1"))
    w, h = F.col("x1") - F.col("x0"), (F.col("y1") - F.col("y0")).cast("double")
    s = F.greatest(w, h)
    return c.raw_laps.join(b, "race_no").select(*KEY, rnd((F.col("lap_time") - F.col("x0")) / s).alias("nx"), rnd((F.col("tyre_life") - F.col("y0")) / s).alias("ny"), rnd(h / w).alias("aspect"))


@query("f_12_report_formatting", laps_sql("""
select race_no, case when race_no % 10 = 9 then 'n/a' else concat(cast(round(100.0 * count(*) filter (where pit_in) / count(*), 0) as int), '%') end as share,
  concat(case when count(*) >= 1000 then '+' else '-' end, abs(count(*) - 1000)) as signed from laps group by race_no"""))
def formatting(c):
    share = F.format_string("%.0f%%", F.round(100.0 * F.count_if("pit_in") / F.count(F.lit(1)), 0))
    d = F.count(F.lit(1)) - 1000
    return c.raw_laps.groupBy("race_no").agg(
        F.when(F.col("race_no") % 10 != 9, share).alias("s"), F.concat(F.when(d >= 0, "+").otherwise("-"), F.abs(d).cast("string")).alias("signed")).select(
        "race_no", F.coalesce("s", F.lit("n/a")).alias("share"), "signed")


@query("f_13_lap_cost", feat_sql(f"""
select race_no, drv, lap, {R('l_scale * (off + slope * (age + 1) + late * greatest(age + 1 - 18, 0))', 5)} as next_lap_cost from f join wl using (compound)""", LAW_SQL))
def next_lap_cost(c):
    """Cost of the next lap on the current tyres."""
    e = F.col("l_scale") * (F.col("off") + F.col("slope") * (F.col("age") + 1) + F.col("late") * F.greatest(F.col("age") + 1 - 18, F.lit(0)))
    return c.laps.join(law(c), "compound").select(*KEY, rnd(e, 5).alias("next_lap_cost"))


@query("f_14_effective_pit_losses", feat_sql(f"""
select circuit, {R('green', 5)} as green, {R('green * 0.5', 5)} as sc, {R('green * vsc_ratio', 5)} as vsc from ptab""", PIT_TABLE_SQL))
def pit_losses(c):
    from gridpace.operators.pit import pit_loss_table
    from gridpace.plans.aggregates import naive_stops
    t = pit_loss_table(naive_stops(c)).withColumn("pl", F.array(F.col("green"), F.col("green") * 0.5, F.col("green") * F.col("vsc_ratio")))
    return t.select("circuit", *[rnd(F.col("pl")[i], 5).alias(n) for i, n in enumerate(("green", "sc", "vsc"))])


@query("f_15_wear_curve", feat_sql(f"""
select circuit, compound, a.age as age, {R('off + slope * a.age + late * greatest(a.age - 18, 0) - (off + slope)', 6)} as vs_fresh
from (select distinct circuit from f) cross join wl cross join (select unnest(generate_series(1, 40)) as age) a""", LAW_SQL))
def wear_curve(c):
    """Seconds lost against the first lap of the set, ages 1 to 40."""
    t = c.laps.select("circuit").distinct().withColumn("compound", F.explode(F.array(*[F.lit(x[0]) for x in WEAR_LAW]))).join(law(c), "compound")
    t = t.withColumn("age", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(40).cast("bigint"))))
    at = lambda a: F.col("off") + F.col("slope") * a + F.col("late") * F.greatest(a - 18, F.lit(0))
    return t.select("circuit", "compound", "age", rnd(at(F.col("age")) - (F.col("off") + F.col("slope"))).alias("vs_fresh"))


@query("f_16_lap_time_decomposition", feat_sql(f"""
select race_no, drv, lap, {R('drv_med')} as base, {R('l_scale * 0.0334 * fuel_kg')} as fuel, {R('l_scale * off')} as compound_offset, {R('l_scale * (slope * age + late * greatest(age - 18, 0))')} as wear,
  {R('l_scale * case when gap_ahead < 1 then 0.3 when gap_ahead < 2 then 0.1 else 0.0 end')} as traffic from f join wl using (compound) where rep""", LAW_SQL))
def decomposition(c):
    """Base, fuel, compound, wear and traffic parts of every representative lap."""
    L = F.col("l_scale")
    traffic = F.when(F.col("gap_ahead") < 1, 0.3).when(F.col("gap_ahead") < 2, 0.1).otherwise(0.0)
    return c.laps.filter("rep").join(law(c), "compound").select(
        *KEY, rnd("drv_med").alias("base"), rnd(L * 0.0334 * F.col("fuel_kg")).alias("fuel"), rnd(L * F.col("off")).alias("compound_offset"),
        rnd(L * (F.col("slope") * F.col("age") + F.col("late") * F.greatest(F.col("age") - 18, F.lit(0)))).alias("wear"), rnd(L * traffic).alias("traffic"))


@query("f_17_nested_documents", feat_sql(f"""
select cl.circuit, cl.race_laps as laps, {R('p_sc', 8)} as p_sc, {R('1 - p_sc - p_vsc', 8)} as stay_green
from (select circuit, arg_max(race_laps, row(year, round_no, driver, lap)) as race_laps from f group by circuit) cl join neut using (circuit)""", NEUTRAL_SQL))
def nested(c):
    """Circuit constants nested in one document and read back out of it."""
    doc = circuit_constants(c.laps).join(neutral_table(lap_states(c)), "circuit").select(
        "circuit", F.struct(F.col("race_laps").alias("laps"), F.map_from_arrays(F.array(F.lit("sc"), F.lit("vsc")), F.array("p_sc", "p_vsc")).alias("p")).alias("doc"))
    return doc.select("circuit", "doc.laps", rnd(F.col("doc.p")["sc"], 8).alias("p_sc"), rnd(1 - F.col("doc.p")["sc"] - F.col("doc.p")["vsc"], 8).alias("stay_green"))


