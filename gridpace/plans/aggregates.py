"""Aggregation queries (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpace.functions.expr import big, rnd, status_bucket
from gridpace.operators import decisions
from gridpace.operators import metrics as m
from gridpace.operators.backtest import forecast_rows, pit_states
from gridpace.operators.field import field_pace
from gridpace.operators.limits import circuit_constants, stint_limits
from gridpace.operators.neutral import lap_states, neutral_table, transition_matrix
from gridpace.operators.pit import control_rows, gap_matched_loss, measured_stops, pit_loss_table, robust
from gridpace.operators.quantile import group_quantile
from gridpace.plans.joins import CONTROL_SQL
from gridpace.plans.sqltext import feat_sql, laps_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.plans.windows import FIELD_SQL, STATE_SQL
from gridpace.registry import query
from gridpace.session import stage

CAR = ["race_no", "drv"]
KEY = ["race_no", "drv", "lap"]
def N():
    return F.count(F.lit(1))


@query("a_01_group_statistics", laps_sql(f"""
select race_no, min(lap_us) as min_us, max(lap_us) as max_us, {R('quantile_cont(lap_time, 0.5)', 5)} as median_lap, {R('avg(lap_time)', 5)} as mean_lap,
  count(*) as n, count(distinct drv) as cars, arg_min(driver, end_us * 100 + drv) as first_across from laps group by race_no"""))
def group_statistics(c):
    g = c.raw_laps.groupBy("race_no").agg(
        F.min("lap_us").alias("min_us"), F.max("lap_us").alias("max_us"), F.avg("lap_time").alias("mean"), N().alias("n"),
        F.count_distinct("drv").alias("cars"), F.min_by("driver", F.struct("end_us", "drv")).alias("first_across"))
    med = group_quantile(c.raw_laps, ["race_no"], F.col("lap_time"), 0.5, "med", bounded=not c.shape.blocked)
    return g.join(med, "race_no").select("race_no", "min_us", "max_us", rnd("med", 5).alias("median_lap"), rnd("mean", 5).alias("mean_lap"), "n", "cars", "first_across")


@query("a_02_dry_race_share", laps_sql(f"""
select race_no, {R("avg(case when compound in ('INTERMEDIATE', 'WET') then 1.0 else 0.0 end)")} as wet_share,
  avg(case when compound in ('INTERMEDIATE', 'WET') then 1.0 else 0.0 end) < 0.02 as dry_race from laps group by race_no"""))
def dry_share(c):
    wet = F.avg(F.col("compound").isin("INTERMEDIATE", "WET").cast("double"))
    return c.raw_laps.groupBy("race_no").agg(rnd(wet).alias("wet_share"), (wet < 0.02).alias("dry_race"))


@query("a_03_broadcast_group_statistic", feat_sql(f"""
select race_no, drv, lap, {R('drv_med')} as drv_med, {R('race_ref')} as race_ref, {R('l_scale', 7)} as l_scale from f"""))
def broadcast_stat(c):
    return c.laps.select(*KEY, rnd("drv_med").alias("drv_med"), rnd("race_ref").alias("race_ref"), rnd("l_scale", 7).alias("l_scale"))


STOPS_SQL = CONTROL_SQL + """,
gm as (
  select race_no, drv, lap, g0, g1, count(other) as controls, max(row(c0, c1)) filter (where c0 <= g0) as lo, min(row(c0, c1)) filter (where c0 > g0) as hi
  from stopctl where g0 is not null and g1 is not null group by all),
gl as (
  select race_no, drv, lap, controls, g1 - case when lo is null then hi[2] when hi is null then lo[2]
    else lo[2] + (hi[2] - lo[2]) * (g0 - lo[1]) / (hi[1] - lo[1]) end as loss_gap from gm where controls >= 3),
nx as (
  select *, lead(pit_out) over c as n_out, lead(lap_time) over c as n_time, lead(red) over c as n_red, lead(sc) over c as n_sc, lead(vsc) over c as n_vsc,
    lead(compound) over c as next_compound from f window c as (partition by race_no, drv order by lap)),
stops as (
  select nx.race_no, nx.drv, nx.lap, race_id, year, circuit, compound, next_compound, age,
    case when sc and n_sc then 1 when vsc and n_vsc then 2 when not (sc or vsc) and not (n_sc or n_vsc) then 0 else -1 end as regime,
    lap_time + n_time - 2 * drv_med as loss_green, loss_gap
  from nx left join gl on nx.race_no = gl.race_no and nx.drv = gl.drv and nx.lap = gl.lap
  where pit_in and n_out and lap_time is not null and n_time is not null and nx.lap > 1 and dry_race and not red and not n_red)"""


def naive_stops(c):
    """Stops measured against the car's median representative lap."""
    return c.memo("naive_stops", lambda: stage(measured_stops(c, c.laps.withColumn("expected", F.col("drv_med"))), "naive-stops"))


@query("a_04_pit_events", feat_sql(f"""
select race_no, drv, lap, compound, next_compound, age, {R('loss_green', 5)} as loss_green, {R('loss_gap', 5)} as loss_gap,
  {R('case when regime = 0 then loss_green else loss_gap end', 5)} as loss from stops""", STOPS_SQL))
def pit_events(c):
    return naive_stops(c).select(*KEY, "compound", "next_compound", "age", rnd("loss_green", 5).alias("loss_green"),
                                 rnd("loss_gap", 5).alias("loss_gap"), rnd("loss", 5).alias("loss"))


@query("a_05_stop_regime", feat_sql("select circuit, cast(regime as int) as regime, count(*) as stops from stops group by all", STOPS_SQL))
def regimes(c):
    return naive_stops(c).groupBy("circuit", "regime").agg(N().alias("stops"))


@query("a_06_gap_to_leader", laps_sql("""
select race_no, drv, lap, round((end_us - min(end_us) over (partition by race_no, lap)) / 1000000.0::double, 6) as gap from laps"""))
def gap_to_leader(c):
    w = Window.partitionBy("race_no", "lap")
    return c.raw_laps.select(*KEY, F.round((F.col("end_us") - F.min("end_us").over(w)) / F.lit(1e6), 6).alias("gap"))


@query("a_07_gap_matched_loss", feat_sql(f"select race_no, drv, lap, controls, {R('loss_gap')} as loss_gap from gl", STOPS_SQL))
def gap_loss(c):
    return gap_matched_loss(control_rows(c)).select(*KEY, "controls", rnd("loss_gap").alias("loss_gap"))


def robust_sql(src, keys, x, name):
    k = f"{keys}," if keys else ""
    by = f"group by {keys}" if keys else ""
    j = lambda a, b: f"{a} join {b} using ({keys})" if keys else f"{a} cross join {b}"
    return f"""{name}v as (select {k} {x} as x from {src} where {x} is not null),
{name}m1 as (select {k} quantile_cont(x, 0.5) as m1 from {name}v {by}),
{name}k as (select {k} x from {j(name + 'v', name + 'm1')} where x < m1 + 8),
{name}m2 as (select {k} quantile_cont(x, 0.5) as med, count(*) as n from {name}k {by}),
{name} as (select {k} any_value(med) as med, 1.4826 * quantile_cont(abs(x - med), 0.5) as mad, any_value(n) as n from {j(name + 'k', name + 'm2')} {by})"""


@query("a_08_robust_location", feat_sql(f"select circuit, {R('med', 5)} as med, {R('mad', 5)} as mad, n from rb", STOPS_SQL, robust_sql("stops", "circuit", "loss_green", "rb")))
def robust_location(c):
    return robust(naive_stops(c), ["circuit"], "loss_green").select("circuit", rnd("med", 5).alias("med"), rnd("mad", 5).alias("mad"), "n")


PIT_TABLE_SQL = (STOPS_SQL + ", ev as (select * from stops where loss_green between 5 and 80), gr as (select * from ev where regime = 0), "
    "py as (select circuit, year, count(*) as ny from gr group by all), pk as (select circuit, max(year) as last, arg_max(ny, year) as n_last, cast(sum(ny) as bigint) as n_green from py group by circuit), "
    "us as (select gr.* from gr join pk using (circuit) where n_last < 6 or year = last), "
    + robust_sql("us", "circuit", "loss_green", "rl") + ", " + robust_sql("gr", "", "loss_green", "rg") + ", " + robust_sql("gr", "", "loss_gap", "rp")
    + """, rr as (select coalesce(greatest(least((select quantile_cont(loss_gap, 0.5) from stops where regime = 1) / rp.med, 1.0), 0.0), 0.5) as sc_ratio,
  coalesce(greatest(least((select quantile_cont(loss_gap, 0.5) from stops where regime = 2) / rp.med, 1.0), 0.0), 0.5) as vsc_ratio from rp),
ptab as (select rl.circuit, rl.med as green, case when rl.n > 3 then rl.mad else rg.mad end as green_sd, n_green, sc_ratio, vsc_ratio
  from rl join pk using (circuit) cross join rg cross join rr
  union all select '_global', rg.med, rg.mad, (select count(*) from gr), sc_ratio, vsc_ratio from rg cross join rr)""")


@query("a_09_pit_loss_table", feat_sql(f"""
select circuit, {R('green', 5)} as green, {R('green_sd', 5)} as green_sd, n_green, {R('sc_ratio')} as sc_ratio, {R('vsc_ratio')} as vsc_ratio from ptab""", PIT_TABLE_SQL))
def loss_table(c):
    return pit_loss_table(naive_stops(c)).select("circuit", rnd("green", 5).alias("green"), rnd("green_sd", 5).alias("green_sd"), "n_green",
                                                 rnd("sc_ratio").alias("sc_ratio"), rnd("vsc_ratio").alias("vsc_ratio"))


@query("a_10_majority_state", feat_sql("select race_no, lap, cast(state as int) as state from st", STATE_SQL))
def majority(c):
    return lap_states(c).select("race_no", "lap", "state")


NEUTRAL_SQL = STATE_SQL + """,
risk as (select * from pv where prev = 0),
gg as (select avg(case when state = 1 then 1.0 else 0.0 end) as g_sc, avg(case when state = 2 then 1.0 else 0.0 end) as g_vsc from risk),
ln as (select count(*) filter (where state = 1)::double / greatest(count(*) filter (where state = 1 and prev <> 1), 1) as len_sc,
  count(*) filter (where state = 2)::double / greatest(count(*) filter (where state = 2 and prev <> 2), 1) as len_vsc from pv),
neut as (
  select circuit, (count(*) filter (where state = 1) + 200 * any_value(g_sc)) / (count(*) + 200) as p_sc,
    (count(*) filter (where state = 2) + 200 * any_value(g_vsc)) / (count(*) + 200) as p_vsc, any_value(len_sc) as len_sc, any_value(len_vsc) as len_vsc,
    count(*) as laps_at_risk from risk cross join gg cross join ln group by circuit
  union all select '_global', g_sc, g_vsc, len_sc, len_vsc, null from gg cross join ln)"""


@query("a_11_onset_hazards", feat_sql(f"select circuit, {R('p_sc', 8)} as p_sc, {R('p_vsc', 8)} as p_vsc, laps_at_risk from neut", NEUTRAL_SQL))
def hazards(c):
    return neutral_table(lap_states(c)).select("circuit", rnd("p_sc", 8).alias("p_sc"), rnd("p_vsc", 8).alias("p_vsc"), "laps_at_risk")


@query("a_12_mean_run_length", feat_sql(f"""
select cast(state as int) as state, count(*) as laps, count(*) filter (where prev <> state) as runs, {R('count(*)::double / greatest(count(*) filter (where prev <> state), 1)')} as mean_len
from pv where state <> 0 group by state""", STATE_SQL))
def run_length(c):
    runs = F.count_if(F.col("prev") != F.col("state"))
    return lap_states(c).filter("state <> 0").groupBy("state").agg(N().alias("laps"), runs.alias("runs"), rnd(N() / F.greatest(runs, F.lit(1))).alias("mean_len"))


@query("a_13_transition_matrix", feat_sql(f"""
, q as (select *, 1 - 1 / greatest(len_sc, 1.01) as q_sc, 1 - 1 / greatest(len_vsc, 1.01) as q_vsc from neut)
select circuit, {R('1 - p_sc - p_vsc')} as gg, {R('p_sc')} as gs, {R('p_vsc')} as gv, {R('1 - q_sc')} as sg, {R('q_sc')} as ss, {R('1 - q_vsc')} as vg, {R('q_vsc')} as vv,
  true as rows_sum_to_one from q""".strip(), NEUTRAL_SQL))
def matrix(c):
    t = neutral_table(lap_states(c)).withColumn("m", transition_matrix(F.col("p_sc"), F.col("p_vsc"), F.col("len_sc"), F.col("len_vsc")))
    at = lambda i, j: F.col("m")[i][j]
    one = F.forall("m", lambda r: F.abs(F.aggregate(r, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-12)
    return t.select("circuit", *[rnd(at(i, j)).alias(n) for n, i, j in (("gg", 0, 0), ("gs", 0, 1), ("gv", 0, 2), ("sg", 1, 0), ("ss", 1, 1), ("vg", 2, 0), ("vv", 2, 2))],
                    one.alias("rows_sum_to_one"))


LIMIT_SQL = """se as (select race_no, drv, stint, any_value(circuit) as circuit, arg_min(compound, lap) as compound, max(age) as age from f
  where dry_race and compound in ('SOFT', 'MEDIUM', 'HARD') group by race_no, drv, stint),
lims as (select circuit, compound, quantile_cont(age, 0.95) as max_age, count(*) as stints from se group by circuit, compound having count(*) >= 10
  union all select '_global', compound, quantile_cont(age, 0.95), count(*) from se group by compound)"""


@query("a_14_stint_limits", feat_sql(f"select circuit, compound, {R('max_age')} as max_age, stints from lims", LIMIT_SQL))
def limits(c):
    return stint_limits(c.laps).select("circuit", "compound", rnd("max_age").alias("max_age"), "stints")


@query("a_15_circuit_constants", feat_sql(f"""
select circuit, {R('arg_max(l_scale, row(year, round_no, driver, lap))', 8)} as l_scale, {R('quantile_cont(track_temp, 0.5)')} as track_temp,
  arg_max(race_laps, row(year, round_no, driver, lap)) as race_laps from f group by circuit"""))
def constants(c):
    return circuit_constants(c.laps).select("circuit", rnd("l_scale", 8).alias("l_scale"), rnd("track_temp").alias("track_temp"), "race_laps")


@query("a_16_circuit_base_pace", feat_sql(f"""
, lr as (select circuit, arg_max(race_no, row(year, round_no)) as race_no from f group by circuit),
fe as (select distinct race_no, drv, drv_med from f where drv_med is not null)
select circuit, {R('quantile_cont(drv_med, 0.5)')} as base from lr join fe using (race_no) group by circuit""".strip()))
def base_pace(c):
    """Median base pace of each circuit's latest race, from a per-car base table (here the median lap)."""
    cars = c.laps.groupBy("circuit", "race_no", "drv").agg(F.max("year").alias("year"), F.max("round_no").alias("round_no"), F.max("drv_med").alias("fe"))
    last = cars.groupBy("circuit").agg(F.max_by("race_no", F.struct("year", "round_no")).alias("race_no"))
    return (cars.join(F.broadcast(last), ["circuit", "race_no"]).filter("fe is not null")  # one row per circuit
            .groupBy("circuit").agg(rnd(F.percentile("fe", F.lit(0.5))).alias("base")))


@query("a_17_team_pace", laps_sql(f"""
, g as (select * from laps where not regexp_matches(track_status, '[24567]') and year in (2021, 2022, 2023)),
tb as (select race_no, year, team, min(lap_us) as tb from g group by all), rb as (select race_no, min(lap_us) as rb from g group by all),
tp as (select year, team, avg(tb - rb) / 1000000 as pace from tb join rb using (race_no) group by all)
select y.year, y.team, {R('coalesce(tp.pace, (select avg(pace) from tp))')} as team_pace from (select distinct year, team from laps) y left join tp using (year, team)""".strip()))
def team_pace(c):
    """Average deficit of a team's best green lap to the race best, training seasons only; others take the mean."""
    g = c.raw_laps.filter((status_bucket(F.col("track_status")) == "green") & F.col("year").isin(2021, 2022, 2023))
    tb = g.groupBy("race_no", "year", "team").agg(F.min("lap_us").alias("tb"))
    tb = tb.withColumn("rb", F.min("tb").over(Window.partitionBy("race_no")))  # one row per team
    tp = tb.groupBy("year", "team").agg((F.avg(F.col("tb") - F.col("rb")) / F.lit(1e6)).alias("pace"))
    mean = tp.agg(F.avg("pace").alias("mean")).withColumn("k", F.lit(0))
    every = c.raw_laps.select("year", "team").distinct().join(tp, ["year", "team"], "left").withColumn("k", F.lit(0))
    return every.join(F.broadcast(mean), "k").select("year", "team", rnd(F.coalesce("pace", "mean")).alias("team_pace"))


@query("a_18_personal_best", laps_sql("""
select race_no, drv, lap, round((lap_us - min(case when not regexp_matches(track_status, '[24567]') then lap_us end) over (partition by driver, year, circuit, race_no))
  / 1000000.0::double, 6) as delta from laps"""))
def personal_best(c):
    pb = c.raw_laps.filter(status_bucket(F.col("track_status")) == "green").groupBy("driver", "year", "circuit", "race_no").agg(F.min("lap_us").alias("pb"))
    return c.raw_laps.join(pb, ["driver", "year", "circuit", "race_no"], "left").select(*KEY, F.round((F.col("lap_us") - F.col("pb")) / F.lit(1e6), 6).alias("delta"))


@query("a_19_deduplicate", laps_sql("""
, d as (select end_us, driver, lap, year, circuit from laps union all select end_us, driver, lap, year, circuit from laps where cents % 3 = 0)
select year, count(*) as kept from (select distinct * from d) group by year""".strip()))
def dedupe(c):
    cols = ["end_us", "driver", "lap", "year", "circuit"]
    d = c.raw_laps.select(*cols).unionByName(c.raw_laps.filter("cents % 3 = 0").select(*cols))
    return d.dropDuplicates(cols).groupBy("year").agg(N().alias("kept"))


FORECAST_SQL = """ckr as (select race_no, drv, k, lap, lap_time, row_number() over (partition by race_no, drv, k order by lap desc) as rn, count(*) over (partition by race_no, drv, k) as n_obs,
  count(*) over (partition by race_no, k) as race_obs from f, (select unnest(generate_series(5, (select max(race_laps) from f), 5)) as k) where rep and lap <= k and k < race_laps - 1),
ck as (select race_no, drv, k, max(case when rn = 1 then lap_time end) as last_lap, avg(case when rn <= 5 then lap_time end) as mean_last5, any_value(n_obs) as n_obs
  from ckr where race_obs >= 30 group by all having any_value(n_obs) >= 3),
fc as (select f.race_no, f.drv, f.lap, f.year, f.lap_time as y, k, last_lap, mean_last5, n_obs, f.lap - k as h from f join ck on f.race_no = ck.race_no and f.drv = ck.drv and f.lap > k where f.rep)"""


@query("a_20_regression_metrics", feat_sql(f"""
select year, count(*) as n, {R('avg(abs(y - last_lap))')} as mae, {R('sqrt(avg((y - last_lap) * (y - last_lap)))')} as rmse,
  {R('1 - sum((y - last_lap) * (y - last_lap)) / (var_pop(y) * count(*))')} as r2, {R('avg(abs((y - last_lap) / y)) * 100')} as mape,
  {R('quantile_cont(abs(y - last_lap), 0.5)')} as median_ae from fc group by year""", FORECAST_SQL))
def regression(c):
    f = forecast_rows(c)
    g = m.regression_metrics(f, ["year"], "y", "last_lap").join(m.median_abs_error(f, ["year"], "y", "last_lap"), "year")
    return g.select("year", "n", *[rnd(x).alias(x) for x in ("mae", "rmse", "r2", "mape", "median_ae")])


@query("a_21_horizon_error_table", feat_sql(f"""
, u as (select h, 'last_lap' as model, y - last_lap as e from fc union all select h, 'mean_last5', y - mean_last5 from fc),
b as (select model, e, unnest(['all', case when h <= 5 then '1-5' when h <= 10 then '6-10' when h <= 20 then '11-20' when h <= 99 then '21-99' end]) as bin from u)
select model, bin, count(*) as n, {R('avg(abs(e))')} as mae, {R('sqrt(avg(e * e))')} as rmse from b where bin is not null group by all""".strip(), FORECAST_SQL))
def horizon(c):
    u = forecast_rows(c).unpivot(["h", "y"], ["last_lap", "mean_last5"], "model", "p").withColumn("e", F.col("y") - F.col("p"))
    u = u.withColumn("bin", F.expr("case when h <= 5 then '1-5' when h <= 10 then '6-10' when h <= 20 then '11-20' when h <= 99 then '21-99' end"))
    g = u.groupBy("model", "bin").agg(N().alias("n"), F.sum(F.abs("e")).alias("a"), F.sum(F.col("e") * F.col("e")).alias("s"))
    both = g.filter("bin is not null").unionByName(g.groupBy("model").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("s").alias("s")).withColumn("bin", F.lit("all")))
    return both.select("model", "bin", "n", rnd(F.col("a") / F.col("n")).alias("mae"), rnd(F.sqrt(F.col("s") / F.col("n"))).alias("rmse"))


STATES_SQL = """ps0 as (select *, coalesce(lead(pit_out) over (partition by race_no, drv order by lap), false) as next_out from f),
ps1 as (select *, case when pit_in and next_out then 1 else 0 end as y, case when sc then 1 when vsc then 2 else 0 end as status, age / (age + 20.0::double) as p from ps0
  where dry_race and lap >= 2 and lap <= race_laps - 1 and not pit_out and not red and compound in ('SOFT', 'MEDIUM', 'HARD') and not (pit_in and not next_out)),
ps as (select *, case when p >= 0.5 then 1 else 0 end as call from ps1)"""


@query("a_22_precision_recall", feat_sql(f"""
, t as (select year, count(*) filter (where y = 1 and call = 1) as tp, count(*) filter (where y = 0 and call = 1) as fp, count(*) filter (where y = 1 and call = 0) as fn from ps group by year)
select year, tp, fp, fn, {R('coalesce(tp::double / nullif(tp + fp, 0), 0)')} as precision, {R('coalesce(tp::double / nullif(tp + fn, 0), 0)')} as recall,
  {R('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1 from t""".strip(), STATES_SQL))
def precision_recall(c):
    g = m.classification(pit_states(c), ["year"])
    return g.select("year", "tp", "fp", "fn", *[rnd(x).alias(x) for x in ("precision", "recall", "f1")])


RANK_SQL = """sc0 as (select p as s, sum(y) as pos, count(*) - sum(y) as neg from ps group by p),
sc1 as (select *, coalesce(sum(pos) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as pa,
  coalesce(sum(neg) over (order by s desc rows between unbounded preceding and 1 preceding), 0) as na from sc0)"""


@query("a_23_roc_auc", feat_sql(f"select {R('sum(neg * (pa + pos / 2.0::double)) / (sum(pos)::double * sum(neg))', 9)} as roc_auc from sc1", STATES_SQL, RANK_SQL))
def roc_auc(c):
    return m.ranking_metrics(m.score_steps(pit_states(c))).select(rnd("roc_auc", 9).alias("roc_auc"))


@query("a_24_average_precision", feat_sql(f"select {R('sum(pos * (pa + pos)::double / (pa + pos + na + neg)) / sum(pos)', 9)} as average_precision from sc1", STATES_SQL, RANK_SQL))
def average_precision(c):
    return m.ranking_metrics(m.score_steps(pit_states(c))).select(rnd("average_precision", 9).alias("average_precision"))


def tol_sql(src, k, keys=""):
    kk = f"{keys}, " if keys else ""
    eq = f"and a.{keys} = b.{keys} " if keys else ""
    hit = lambda col: f"exists (select 1 from {src} b where b.race_no = a.race_no and b.drv = a.drv {eq}and b.{col} = 1 and abs(b.lap - a.lap) <= {k})"
    by = f"group by {keys}" if keys else ""
    return f"""tr as (select {kk} count(*) as n_real, count(*) filter (where {hit('call')}) as hit_real from {src} a where y = 1 {by}),
tc as (select {kk} count(*) as n_call, count(*) filter (where {hit('y')}) as hit_call from {src} a where call = 1 {by})"""


@query("a_25_tolerant_precision_recall", feat_sql(f"""
, t as (select *, hit_call::double / greatest(n_call, 1) as pr, hit_real::double / greatest(n_real, 1) as re from tr join tc using (year))
select year, n_real, hit_real, n_call, hit_call, {R('2 * pr * re / greatest(pr + re, 0.000000001)')} as f1 from t""".strip(), STATES_SQL, tol_sql("ps", 2, "year")))
def tolerant(c):
    return m.tolerant(pit_states(c), ["year"], 2).select("year", "n_real", "hit_real", "n_call", "hit_call", rnd("f1").alias("f1"))


FIRST_SQL = """fs as (select year, race_no, drv, stint, min(case when y = 1 then lap end) as real, min(case when call = 1 then lap end) as fcall from ps group by all),
fx as (select *, fcall - real as err, coalesce(abs(fcall - real), 1000000000) as a from fs where real is not null)"""


@query("a_26_first_call_error", feat_sql(f"""
select year, count(*) as stints, {R('avg(case when err is null then 1.0 else 0.0 end)')} as never_called,
  {R('case when quantile_cont(a, 0.5) < 100000000 then quantile_cont(a, 0.5) end')} as median_abs_laps, {R('avg(case when a <= 2 then 1.0 else 0.0 end)')} as within_2_laps,
  {R('avg(case when a <= 5 then 1.0 else 0.0 end)')} as within_5_laps, {R('quantile_cont(err, 0.5)')} as median_signed_laps from fx group by year""", STATES_SQL, FIRST_SQL))
def first_call(c):
    g = m.first_call_summary(m.first_call_errors(pit_states(c), ["year"]), ["year"])
    return g.select("year", "stints", *[rnd(x).alias(x) for x in ("never_called", "median_abs_laps", "within_2_laps", "within_5_laps", "median_signed_laps")])


@query("a_27_neutral_balanced_accuracy", feat_sql(f"""
, n as (select year, avg(case when y = 1 then call::double end) as tpr, avg(case when y = 0 then 1 - call::double end) as tnr, count(*) as states, cast(sum(y) as bigint) as stops,
  count(*) filter (where y = 1 and call = 1) as tp, count(*) filter (where y <> call) as wrong from ps where status <> 0 group by year)
select year, states, stops, {R('case when tpr is null then tnr when tnr is null then tpr else (tpr + tnr) / 2 end')} as balanced_accuracy,
  {R('coalesce(2.0 * tp / nullif(2 * tp + wrong, 0), 0)')} as f1_neutral from n""".strip(), STATES_SQL))
def neutral(c):
    return m.neutral_metrics(pit_states(c), ["year"]).select("year", "states", "stops", rnd("balanced_accuracy").alias("balanced_accuracy"), rnd("f1_neutral").alias("f1_neutral"))


@query("a_28_threshold_search", feat_sql(f"""
, g as (select i, 0.05::double + i * 0.01::double as t from (select unnest(generate_series(0, 94)) as i)),
x as (select i, t, count(*) filter (where p >= t) as called, count(*) filter (where p >= t and y = 1) as tp, count(*) filter (where y = 1) as np from g, ps group by i, t)
select cast(i as int) as i, {R('t')} as threshold, called, tp, {R('coalesce(2.0 * tp / nullif(called + np, 0), 0)')} as f1,
  i = first_value(i) over (order by coalesce(2.0 * tp / nullif(called + np, 0), 0) desc, i) as best from x""".strip(), STATES_SQL))
def thresholds(c):
    t = m.threshold_table(pit_states(c))
    best = F.max_by("i", F.struct("f1", -F.col("i"))).over(Window.partitionBy(F.lit(0)))  # 95 rows
    return t.select("i", rnd("threshold").alias("threshold"), "called", "tp", rnd("f1").alias("f1"), (F.col("i") == best).alias("best"))


@query("a_29_tuning_objective", feat_sql(f"""
, pz as (select gr.margin, race_no, drv, lap, stint, y, status, case when age - 20 > gr.margin then 1 else 0 end as call from ps1, (values (0), (1), (2), (3), (4), (6)) gr(margin) where year = 2024),
{tol_sql('pz', 2, 'margin')},
fz as (select margin, race_no, drv, stint, min(case when y = 1 then lap end) as real, min(case when call = 1 then lap end) as fcall from pz group by all),
wz as (select margin, avg(case when abs(fcall - real) <= 2 then 1.0 else 0.0 end) as w2 from fz where real is not null group by margin),
nz as (select margin, avg(case when y = 1 then call::double end) as tpr, avg(case when y = 0 then 1 - call::double end) as tnr from pz where status <> 0 group by margin),
o as (select margin, 2 * (hit_call::double / greatest(n_call, 1)) * (hit_real::double / greatest(n_real, 1)) / greatest((hit_call::double / greatest(n_call, 1)) + (hit_real::double / greatest(n_real, 1)), 0.000000001) as f1_2,
  w2, case when tpr is null then tnr when tnr is null then tpr else (tpr + tnr) / 2 end as bal from tr left join tc using (margin) join wz using (margin) join nz using (margin))
select cast(margin as int) as margin, {R('f1_2')} as f1_2, {R('w2')} as within_2_laps, {R('bal')} as balanced_accuracy, {R('(f1_2 + w2 + bal) / 3')} as objective from o""".strip(),
STATES_SQL))
def tuning(c):
    """Every margin of the grid scored on the development season; the objective is the mean of three metrics."""
    s = pit_states(c).filter("year = 2024").withColumn("margin", F.explode(F.array(*[F.lit(x) for x in (0, 1, 2, 3, 4, 6)])))
    s = s.withColumn("call", (F.col("age") - 20 > F.col("margin")).cast("int")).select("margin", *KEY, "stint", "y", "status", "call")
    t = m.tolerant(s, ["margin"], 2).select("margin", F.col("f1").alias("f1_2"))
    w = m.first_call_summary(m.first_call_errors(s, ["margin"]), ["margin"]).select("margin", "within_2_laps")
    n = m.neutral_metrics(s, ["margin"]).select("margin", "balanced_accuracy")
    j = t.join(w, "margin").join(n, "margin")
    cols = ["f1_2", "within_2_laps", "balanced_accuracy"]
    return j.select("margin", *[rnd(x).alias(x) for x in cols], rnd(sum(F.col(x) for x in cols) / 3).alias("objective"))


@query("a_29_optimiser_tuning")
def optimiser_tuning(c):
    """Every setting of the optimiser (wear prior, stop cost under a safety car, margin) scored by its own gains on the development season."""
    def make():
        s = decisions.setting_gains(c).withColumn("margin", F.explode(F.array(*[F.lit(x) for x in decisions.MARGINS])))
        s = s.withColumn("call", (F.col("gain") > F.col("margin")).cast("int"))
        k = ["setting", "margin"]
        t = m.tolerant(s, k, 2).select(*k, F.col("f1").alias("f1_2"))
        w = m.first_call_summary(m.first_call_errors(s, k), k).select(*k, "within_2_laps", "never_called", "median_signed_laps")
        n = m.neutral_metrics(s, k).select(*k, "balanced_accuracy")
        f = m.classification(s, k).select(*k, "f1")
        names = c.spark.createDataFrame([(i, d, sc) for i, (d, sc) in enumerate(decisions.SETTINGS)], "setting int, deg_sd double, sc double")
        j = f.join(t, k, "left").join(w, k, "left").join(n, k, "left").join(F.broadcast(names), "setting")  # 16 rows
        score = (F.col("f1_2") + F.col("within_2_laps") + F.col("balanced_accuracy")) / 3
        return stage(j.select("deg_sd", "sc", "margin", score.alias("objective"), "f1_2", "within_2_laps", "balanced_accuracy", "never_called", "f1",
                              "median_signed_laps"), "optimiser-tuning")
    return c.memo("optimiser_tuning", make)


@query("a_32_eda_summaries", laps_sql(f"""
select 'compound' as dim, compound as value, count(*) as n, {R('quantile_cont(lap_time, 0.5)', 5)} as median_lap from laps group by compound
union all select 'circuit', circuit, count(*), {R('quantile_cont(lap_time, 0.5)', 5)} from laps group by circuit
union all select 'lap', cast(lap as varchar), count(*), {R('quantile_cont(lap_time, 0.5)', 5)} from laps group by lap"""))
def eda(c):
    """Medians over groups as large as a third of the table: bracketed by a sketch, then exact."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(x).cast("string").alias("value")) for d, x in (("compound", "compound"), ("circuit", "circuit"), ("lap", "lap"))])
    x = c.raw_laps.select(F.explode(dims).alias("k"), "lap_time").select("k.dim", "k.value", "lap_time")
    med = group_quantile(x, ["dim", "value"], F.col("lap_time"), 0.5, "med")
    return x.groupBy("dim", "value").agg(N().alias("n")).join(med, ["dim", "value"]).select("dim", "value", "n", rnd("med", 5).alias("median_lap"))


@query("a_33_field_pace", feat_sql(f"select race_no, lap, {R('field_med')} as field_med, status from fp", FIELD_SQL))
def field(c):
    return field_pace(c).select("race_no", "lap", rnd("field_med").alias("field_med"), "status")


@query("a_34_status_spans", feat_sql("""
, x as (select race_no, lap, min(row(end_us, drv, start_us)) as first_car, bool_or(sc) as s, bool_or(vsc) as v from f group by all)
select race_no, lap, case when lap = 1 then 0 else first_car[3] end as from_us, first_car[1] as to_us, case when s then 'S' else 'V' end as status from x where s or v""".strip()))
def spans(c):
    """Clock interval of each neutralised lap, from the first car across the line."""
    x = c.laps.groupBy("race_no", "lap").agg(F.min(F.struct("end_us", "drv", "start_us")).alias("a"), F.bool_or("sc").alias("s"), F.bool_or("vsc").alias("v"))
    return x.filter("s or v").select("race_no", "lap", F.when(F.col("lap") == 1, F.lit(0)).otherwise(F.col("a.start_us")).cast("bigint").alias("from_us"),
                                     F.col("a.end_us").alias("to_us"), F.when(F.col("s"), "S").otherwise("V").alias("status"))


@query("a_35_forecast_mae_per_driver", feat_sql(f"""
select race_no, drv, count(*) as laps, {R('avg(abs(lap_time - prev))')} as mae from (select *, lag(lap_time) over (partition by race_no, drv order by lap) as prev from f where rep)
where prev is not null group by all""", ))
def mae_per_driver(c):
    from gridpace.operators.scan import framed
    n = c.shape.block_laps
    r = c.laps.filter("rep").select(*KEY, "rep_no", "lap_time", F.expr(f"(rep_no - 1) div {n}").alias("blk"))
    r = framed(r, CAR, {"prev": lambda w: F.lag("lap_time").over(w)}, order="rep_no", before=1, blk=c.blk, block_laps=n)
    return r.filter("prev is not null").groupBy(*CAR).agg(N().alias("laps"), rnd(F.avg(F.abs(F.col("lap_time") - F.col("prev")))).alias("mae"))


@query("a_36_most_neutralised_race", feat_sql("""
, n as (select year, race_no, count(distinct lap) filter (where sc) as sc_laps from f group by all), s as (select year, race_no, drv, count(*) filter (where pit_in) as stops from f group by all)
select n.year, arg_max(n.race_no, n.sc_laps * 1000000 - n.race_no) as race_no, max(n.sc_laps) as sc_laps, any_value(b.race_no) as busy_race, any_value(b.drv) as busy_drv, any_value(b.stops) as stops
from n join (select year, arg_max(race_no, stops * 1000000000 - race_no * 100 - drv) as race_no, arg_max(drv, stops * 1000000000 - race_no * 100 - drv) as drv, max(stops) as stops from s group by year) b
on n.year = b.year group by n.year""".strip()))
def most_neutralised(c):
    f = c.laps
    n = f.groupBy("year", "race_no", "lap").agg(F.bool_or("sc").alias("s")).groupBy("year", "race_no").agg(F.count_if("s").alias("sc_laps"))
    s = f.groupBy("year", "race_no", "drv").agg(F.count_if("pit_in").alias("stops"))
    a = n.groupBy("year").agg(F.max(F.struct("sc_laps", (-F.col("race_no")).alias("r"))).alias("m"))
    b = s.groupBy("year").agg(F.max(F.struct("stops", (-F.col("race_no")).alias("r"), (-F.col("drv")).alias("d"))).alias("b"))
    return a.join(b, "year").select("year", (-F.col("m.r")).alias("race_no"), "m.sc_laps", (-F.col("b.r")).alias("busy_race"), (-F.col("b.d")).alias("busy_drv"), "b.stops")


@query("a_37_expected_neutralisations", feat_sql(f"""
, cl as (select circuit, arg_max(race_laps, row(year, round_no, driver, lap)) as race_laps, count(*) filter (where pit_in) as stops from f group by circuit)
select circuit, {R('p_sc * (race_laps - 1)')} as sc_per_race, {R('p_vsc * (race_laps - 1)')} as vsc_per_race, stops from cl join neut using (circuit)""".strip(), NEUTRAL_SQL))
def expected(c):
    cl = circuit_constants(c.laps).select("circuit", "race_laps").join(c.laps.groupBy("circuit").agg(F.count_if("pit_in").alias("stops")), "circuit")
    return cl.join(neutral_table(lap_states(c)), "circuit").select(
        "circuit", rnd(F.col("p_sc") * (F.col("race_laps") - 1)).alias("sc_per_race"), rnd(F.col("p_vsc") * (F.col("race_laps") - 1)).alias("vsc_per_race"), "stops")
