"""Batch decision queries (D), policy joins and the model-based back-tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gridpace.constants import CLIFF, DEV_YEARS, DRY, KNOTS, SC_RATIO_EFF, TEST_YEARS, TRAIN_YEARS
from gridpace.functions.expr import hinge, rnd, status_letter
from gridpace.operators import backtest, bundle, decisions
from gridpace.operators import metrics as m
from gridpace.operators.asof_fit import asof_linear_fits, linear_prediction
from gridpace.operators.limits import circuit_constants, stint_limits
from gridpace.operators.ridge import GLOBAL
from gridpace.operators.scan import framed
from gridpace.plans.aggregates import FORECAST_SQL, LIMIT_SQL, PIT_TABLE_SQL, naive_stops
from gridpace.plans.sqltext import feat_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query
from gridpace.session import stage
from gridpace.sources.files import round_trip

CAR = ["race_no", "drv"]
KEY = ["race_no", "drv", "lap"]

# a wear law known to both engines, so the lap-cost table has a SQL twin
WEAR_LAW = [("SOFT", -0.5, 0.09, 0.004), ("MEDIUM", 0.0, 0.05, 0.003), ("HARD", 0.4, 0.03, 0.002)]


@query("d_01_lap_cost_table", feat_sql(f"""
, cc as (select circuit, arg_max(l_scale, row(year, round_no, driver, lap)) as l_scale, arg_max(race_laps, row(year, round_no, driver, lap)) as race_laps from f group by circuit),
wl(compound, off, slope, late) as (values {', '.join(f"('{c}', {a}::double, {b}::double, {l}::double)" for c, a, b, l in WEAR_LAW)}),
lim as (select cc.circuit, wl.*, l_scale, race_laps, coalesce(l.max_age, g.max_age) as max_age from cc cross join wl left join lims l on l.circuit = cc.circuit and l.compound = wl.compound
  join lims g on g.circuit = '_global' and g.compound = wl.compound)
select circuit, compound, a.age as age, {R('l_scale * (off + slope * a.age + late * greatest(a.age - 18, 0) + 0.05::double * pow(greatest(a.age - max_age, 0), 2))', 5)} as cost
from lim join (select unnest(generate_series(0, (select max(race_laps) + 45 from f))) as age) a on a.age <= race_laps + 45""".strip(), LIMIT_SQL))
def lap_cost(c):
    """Cost of a lap at every tyre age for every circuit and compound, ages 0 .. race length + 45."""
    law = c.spark.createDataFrame(WEAR_LAW, "compound string, off double, slope double, late double")
    lim = stint_limits(c.laps)
    cc = circuit_constants(c.laps).select("circuit", "l_scale", "race_laps").withColumn("compound", F.explode(F.array(*[F.lit(x) for x in DRY])))
    g = lim.filter("circuit = '_global'").select("compound", F.col("max_age").alias("g_age"))
    t = (cc.join(F.broadcast(law), "compound").join(lim.select("circuit", "compound", "max_age"), ["circuit", "compound"], "left")
         .join(F.broadcast(g), "compound")  # three rows
         .withColumn("age", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("race_laps") + 45))))
    over = F.greatest(F.col("age") - F.coalesce("max_age", "g_age"), F.lit(0.0))
    cost = F.col("l_scale") * (F.col("off") + F.col("slope") * F.col("age") + F.col("late") * hinge(F.col("age"), (KNOTS[3],))[0] + CLIFF * over * over)
    return t.select("circuit", "compound", "age", rnd(cost, 5).alias("cost"))


@query("d_02_policy_table")
def policy(c):
    """Per circuit, lap, compound, rule and status: the youngest age at which stopping is the better action."""
    p = decisions.policy_table(c)
    stop = F.col("action") >= 0
    return p.groupBy("circuit", "lap", "c", "f", "s").agg(F.min(F.when(stop, F.col("a"))).alias("stop_from_age"), F.count_if(stop).alias("stopping_ages"),
                                                        F.max(F.col("stay") - F.col("pit")).alias("best_gain"))


@query("d_03_decide_states")
def decide(c):
    fit = F.when(F.col("action") >= 0, F.element_at(F.array(*[F.lit(x) for x in DRY]), F.col("action") + 1))
    return decisions.solved(c).select(*KEY, (F.col("action") >= 0).alias("pit_now"), fit.alias("fit_compound"), F.round(F.col("stay") - F.col("pit"), 2).alias("gain_s"))


@query("j_12_policy_lookup")
def policy_lookup(c):
    """Every state finds its row of the circuit's policy table by lap, compound, age, rule and status."""
    st = decisions.states(c).select(*KEY, "circuit", F.col("comp").alias("c"), "a", "f", "s")
    return st.join(decisions.policy_table(c), ["circuit", "lap", "c", "a", "f", "s"]).groupBy("circuit", "lap").agg(
        F.count(F.lit(1)).alias("states"), F.count_if(F.col("action") >= 0).alias("calls"), F.avg(F.col("stay") - F.col("pit")).alias("mean_gain"))


@query("d_04_replicate_agreement")
def agreement(c):
    """Share of bootstrap replicates that make the point model's call."""
    keys = ["circuit", "lap", "c", "a", "f", "s"]
    point = decisions.policy_table(c).select(*keys, (F.col("action") >= 0).alias("point_pit"))
    return a31(c).join(point, keys).withColumn("agreement", F.when(F.col("point_pit"), F.col("p_pit")).otherwise(1 - F.col("p_pit")))


def a31(c):
    v = decisions.votes(c)
    return v.groupBy("circuit", "lap", "c", "a", "f", "s").agg(F.avg((F.col("action") >= 0).cast("double")).alias("p_pit"), F.count(F.lit(1)).alias("replicates"))


@query("a_31_vote_share")
def vote_share(c):
    return a31(c)


@query("d_05_forward_plan")
def forward_plan(c):
    return decisions.solved(c).select(*KEY, "plan", F.round("plan_cost", 1).alias("remaining_tyre_cost_s"))


@query("d_06_plan_features")
def plan_features(c):
    return decisions.solved(c).select(*KEY, F.col("next_stop").alias("laps_to_plan"), "plan_stops")


@query("d_07_pit_window")
def window(c):
    """Committed-stop curve relative to its best lap, the best lap, and the laps within half a second of it."""
    w = decisions.solved(c).select(*KEY, F.transform("window", lambda x: F.struct(x["lap"].alias("lap"), F.round(x["delta"], 2).alias("delta"))).alias("curve"))
    near = F.transform(F.filter("curve", lambda x: x["delta"] <= 0.5), lambda x: x["lap"])
    best = F.array_min(F.transform("curve", lambda x: F.struct(x["delta"].alias("d"), x["lap"].alias("lap"))))["lap"]
    return w.select(*KEY, "curve", best.alias("best_lap"), near.alias("near_laps"))


@query("d_08_decision_backtest_rows")
def backtest_rows(c):
    return decisions.decisions(c)


@query("d_09_race_replay")
def replay(c):
    """Lap-by-lap calls against real stops for the car with the most stops of each test race."""
    d = decisions.decisions(c).filter(F.col("year").isin(*TEST_YEARS))
    pick = (d.groupBy("race_no", "drv").agg(F.sum("y").alias("n")).groupBy("race_no").agg(F.max_by("drv", F.struct("n", -F.col("drv"))).alias("drv")))
    return d.join(pick, ["race_no", "drv"], "left_semi").select(*KEY, "comp", "age", "status", F.round("dp_gain", 2).alias("dp_gain"), "dp_pit", "y")


@query("d_10_race_time_backtest")
def race_time(c):
    """From lap 10: predicted, actual and naive time of every finisher's remaining green laps and stops."""
    k = 10
    mod = bundle.model(c)
    f = c.laps.filter("dry_race")
    obs = f.filter(F.col("rep") & (F.col("lap") <= k)).groupBy(*CAR).agg(
        F.avg("gap1").alias("g1"), F.avg("gap2").alias("g2"), F.avg("lap_time").alias("mean_k"), F.count(F.lit(1)).alias("n"))
    ok = obs.groupBy("race_no").agg(F.sum("n").alias("n")).filter("n >= 50")
    later = framed(f.filter(F.col("lap") > k), CAR, {
        "n_green": lambda w: F.coalesce(F.lead("green").over(w), F.lit(False)), "n_out": lambda w: F.coalesce(F.lead("pit_out").over(w), F.lit(False)),
        "p_stop": lambda w: F.coalesce(F.lag(F.col("pit_in") & F.col("green")).over(w), F.lit(False))}, before=1, after=1, blk=c.blk, block_laps=c.shape.block_laps)
    racing = F.col("green") & ~F.col("pit_in") & ~F.col("pit_out") & F.col("lap_time").isNotNull() & F.col("compound").isin(*DRY)
    stop = F.col("pit_in") & F.col("green") & F.col("n_green") & F.col("n_out")
    after_stop = F.col("p_stop") & F.col("green") & F.col("pit_out")
    rows = later.withColumn("racing", racing).withColumn("stop", stop).filter(F.col("racing") | F.col("stop") | after_stop)
    rows = rows.join(ok.drop("n"), "race_no", "left_semi").join(obs.drop("n"), CAR).withColumn("gap1", F.col("g1")).withColumn("gap2", F.col("g2"))
    rows = rows.filter(F.col("finish_status").rlike("^Finished") | F.col("finish_status").startswith("+"))
    terms = bundle.asof_terms(c).filter(F.col("k") == k).drop("k", "n_obs")
    p = mod.predict_local(rows, terms, ["race_no"])
    pl = bundle.circuit_params(c).select("circuit", F.col("green").alias("loss"))
    g = p.join(pl, "circuit").groupBy(*CAR, "year").agg(
        F.count(F.lit(1)).alias("laps"), F.count_if("stop").alias("stops"), F.count_if("racing").alias("racing"), F.sum("lap_time").alias("actual"),
        (F.sum("pred") + F.first("loss") * F.count_if("stop")).alias("pred"), (F.first("mean_k") * F.count(F.lit(1)) + 22.0 * F.count_if("stop")).alias("naive"))
    t = g.filter("racing >= 10")
    e = lambda x: F.abs(F.col(x) - F.col("actual"))
    return t.groupBy("year").agg(F.count(F.lit(1)).alias("drivers"), F.avg("laps").alias("mean_laps"), F.avg(e("pred")).alias("mae_s"),
                                 (F.avg(e("pred") / F.col("actual")) * 100).alias("mape_pct"), F.avg(e("naive")).alias("naive_mae_s"),
                                 (F.avg(e("naive") / F.col("actual")) * 100).alias("naive_mape_pct"))


FIT_PIT_SQL = PIT_TABLE_SQL.replace("from stops where loss_green between 5 and 80)", f"from stops where loss_green between 5 and 80 and year in {TRAIN_YEARS})")


@query("d_11_pit_loss_backtest", feat_sql(f"""
, t as (select s.year, s.loss_green, coalesce(p.green, g.green) as pred from stops s left join ptab p on p.circuit = s.circuit join ptab g on g.circuit = '_global'
  where regime = 0 and loss_green between 5 and 80 and s.year not in {TRAIN_YEARS})
select year, count(*) as stops, {R('avg(abs(loss_green - pred))', 5)} as mae_circuit, {R('avg(abs(loss_green - 22.0))', 5)} as mae_constant from t where loss_green < pred + 8 group by year""".strip(),
FIT_PIT_SQL))
def pit_loss_backtest(c):
    """Each green stop after the fit seasons against its circuit's table value (or the global one) and against a constant 22 s."""
    from gridpace.operators.pit import pit_loss_table
    tab = c.memo("naive_pit_table", lambda: stage(pit_loss_table(naive_stops(c).filter(F.col("year").isin(*TRAIN_YEARS))), "naive-pit-table"))
    return pit_loss_errors(naive_stops(c).filter(~F.col("year").isin(*TRAIN_YEARS)), tab)


def pit_loss_errors(stops, table):
    stops = stops.filter("regime = 0 and loss_green between 5 and 80")
    t = bundle.with_global(stops, table, ["green"]).filter("loss_green < green + 8")
    return t.groupBy("year").agg(F.count(F.lit(1)).alias("stops"), rnd(F.avg(F.abs(F.col("loss_green") - F.col("green"))), 5).alias("mae_circuit"),
                                 rnd(F.avg(F.abs(F.col("loss_green") - 22.0)), 5).alias("mae_constant"))


@query("d_11_pit_loss_backtest_model")
def pit_loss_backtest_model(c):
    """The same for losses against the model's clean laps, with the table of the seasons that the model was fitted to."""
    return pit_loss_errors(bundle.model_stops(c).filter(~F.col("year").isin(*bundle.FIT_YEARS)), bundle.pit_table(c))


@query("d_12_forecast_backtest_naive", feat_sql(f"""
select race_no, k, count(*) as n, {R('avg(abs(y - last_lap))')} as mae_last, {R('avg(abs(y - mean_last5))')} as mae_mean5 from fc group by all""", FORECAST_SQL))
def forecast_naive(c):
    f = backtest.forecast_rows(c)
    return f.groupBy("race_no", "k").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(F.abs(F.col("y") - F.col("last_lap")))).alias("mae_last"),
                                         rnd(F.avg(F.abs(F.col("y") - F.col("mean_last5")))).alias("mae_mean5"))


FEATURES = ["age", "compound", "lap_in_stint", "gap_ahead", "position", "fuel_kg", "track_temp", "stint", "race_laps", "l_scale", "gap1", "gap2", "circuit"]


def inrace_forecasts(c):
    """Every k = 5, 10, ... against every later representative lap: naive, linear and structural predictions, with booster features."""
    def make():
        f = backtest.forecast_rows(c, *FEATURES)
        fits = bundle.asof_terms(c).drop("n_obs")
        f = bundle.model(c).predict_local(f, fits, ["race_no", "k"], "structural")
        lin = asof_linear_fits(c.laps.filter("rep")).drop("n_obs", "race_coef")
        f = f.join(lin, ["race_no", "k"], "left").withColumn("inrace_linear", linear_prediction()).drop("cars", "fe", "intercept", "extra")
        seen = c.laps.filter("rep").select("race_no", "race_laps", "track_temp", F.explode(F.expr(
            "case when race_laps - 2 >= greatest(5, (lap + 4) div 5 * 5) then sequence(greatest(5, (lap + 4) div 5 * 5), race_laps - 2, 5L) end")).alias("k"))
        temp = seen.groupBy("race_no", "k").agg(F.avg("track_temp").alias("obs_temp"))
        f = f.join(temp, ["race_no", "k"], "left")
        return stage(f.withColumn("dtemp", F.col("track_temp") - F.col("obs_temp")).withColumn("pitted_since", (F.col("stint") > F.col("stint_k")).cast("double"))
                     .withColumn("k_frac", F.col("k") / F.col("race_laps")), "inrace")
    return c.memo("inrace", make)


def split_forecasts(c):
    """(split, forecasts): the development season by the bundle of the training seasons, the test season by that of all before it."""
    dev, test = F.col("year").isin(*DEV_YEARS), F.col("year").isin(*TEST_YEARS)
    return [("dev", inrace_forecasts(bundle.before_development(c)).filter(dev)), ("test", inrace_forecasts(c).filter(test))]


@query("d_12_forecast_backtest")
def forecast_models(c):
    """Error by split and horizon bin for the four forecasters; no split is scored by a bundle that has seen it."""
    d, t = (f.withColumn("split", F.lit(s)) for s, f in split_forecasts(c))
    u = d.unionByName(t).unpivot(["split", "h", "y"], ["last_lap", "mean_last5", "inrace_linear", "structural"], "model", "p")
    b = F.expr("case when h <= 5 then '1-5' when h <= 10 then '6-10' when h <= 20 then '11-20' when h <= 99 then '21-99' end")
    u = u.withColumn("bin", F.explode(F.array(F.lit("all"), b)))
    return m.regression_metrics(u.where("bin is not null"), ["split", "model", "bin"], "y", "p").select("split", "model", "bin", "n", "mae", "rmse")


@query("m_11_inrace_linear_baseline")
def inrace_linear(c):
    return m.regression_metrics(inrace_forecasts(c), ["race_no", "k"], "y", "inrace_linear").select("race_no", "k", "n", "mae", "rmse")


@query("d_13_one_lap_ahead")
def one_lap_ahead(c):
    """Prediction of every dry-tyre lap from the third on, calibrated only on the laps before it."""
    fits = bundle.asof_terms(c).filter("n_obs >= 30").select("race_no", (F.col("k") + 1).alias("lap"), "cars", "fe", "race_coef", "fe_default")
    f = c.laps.filter(F.col("dry_race") & (F.col("lap") >= 3) & F.col("compound").isin(*DRY))
    p = bundle.model(c).predict_local(f, fits, ["race_no", "lap"])
    return p.filter("pred is not null").select(*KEY, "lap_time", "rep", F.round("pred", 3).alias("pred"))


@query("a_35_replay_error_per_driver")
def replay_error(c):
    """Mean absolute error of the one-lap-ahead predictions on representative laps, per race and driver."""
    return one_lap_ahead(c).filter("rep").groupBy(*CAR).agg(F.count(F.lit(1)).alias("laps"), F.avg(F.abs(F.col("lap_time") - F.col("pred"))).alias("mae"))


@query("j_13_scored_row_lookup")
def scored_lookup(c):
    """Replay laps of the test season with the optimiser's gain where the lap was a decision."""
    s = decisions.decisions(c).select(*KEY, F.round("dp_gain", 2).alias("gain"), "dp_pit")
    return c.laps.filter(F.col("year").isin(*TEST_YEARS)).select(*KEY, "lap_time", "pit_in").join(s, KEY, "left")


@query("a_30_bootstrap_bands")
def bands(c):
    """5 and 95 per cent bands of the wear curve per circuit, compound and age across replicates."""
    b = bundle.boots(c)
    t = b.shared_table()
    g = t.filter("circuit is null").groupBy("replicate").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "block", "key"), "value"))).alias("g"))
    cc = t.filter("circuit is not null").groupBy("replicate", "circuit").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "block", "key"), "value"))).alias("c"))
    x = cc.join(g, "replicate").withColumn("compound", F.explode(F.array(*[F.lit(v) for v in DRY]))).withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(40))))
    val = lambda mp, *parts: F.coalesce(F.try_element_at(F.col(mp), F.concat_ws(":", *parts)), F.lit(0.0))
    curve = sum((h * val("g", F.lit("deg0" if j == 0 else "deg"), F.col("compound"), F.lit(str(j))) for j, h in enumerate(hinge(F.col("age")))), F.lit(0.0))
    v = (val("g", F.lit("off_g"), F.col("compound")) + val("c", F.lit("off_circ"), F.col("compound")) + curve
         + F.col("age") * val("c", F.lit("deg_circ"), F.col("compound")))
    q = F.percentile("v", F.array(F.lit(0.05), F.lit(0.95)))  # one value per replicate
    return x.withColumn("v", v).groupBy("circuit", "compound", "age").agg(q.alias("q")).select("circuit", "compound", "age", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


@query("d_14_model_export")
def model_export(c):
    """One nested document per circuit: constants, pit losses, chain and wear terms, also of every bootstrap replicate; and one of what circuits share."""
    mod, b = bundle.model(c), bundle.boots(c)
    shared = lambda g: {f"{block}:{key}": float(v) for (block, key, _), v in zip(GLOBAL, g)}
    whole = {"compounds": list(DRY), "knots": list(KNOTS), "fuel": round(mod.coef("fuel", "fuel"), 5), "sigma": round(float(mod.sigma[0]), 3), "cliff": CLIFF,
             "sc_ratio_eff": SC_RATIO_EFF, "terms": shared(mod.shared[0]), "boots": [{"replicate": r, "terms": shared(g)} for r, g in sorted(b.shared.items())]}
    key = F.concat_ws(":", "block", "key")
    boots = b.shared_table().filter("circuit is not null").groupBy("circuit", "replicate").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.alias("k"), F.round("value", 5).alias("v"))))).alias("terms"))  # a circuit's few terms
    boots = boots.groupBy("circuit").agg(F.array_sort(F.collect_list(F.struct("replicate", "terms")), lambda x, y: x["replicate"] - y["replicate"]).alias("boots"))
    p = bundle.circuit_params(c).join(boots, "circuit", "left")
    names = ("off_soft", "off_hard", "wear_soft", "wear_medium", "wear_hard")
    terms = F.struct(*[F.round(F.col("circ_coef")[i], 5).alias(n) for i, n in enumerate(names)])
    return p.select("circuit", F.to_json(F.struct(
        F.round("l_scale", 4).alias("l"), F.col("race_laps").alias("laps"), F.round("track_temp", 1).alias("temp"), F.round("base", 3).alias("base"),
        F.round("green", 2).alias("pit_green"), F.round("vsc_ratio", 3).alias("pit_vsc_ratio"), F.round("sc_ratio", 3).alias("pit_sc_ratio_measured"),
        F.lit(SC_RATIO_EFF).alias("sc_ratio_eff"), F.col("n_green").alias("n_stops"), F.transform("chain", lambda x: F.round(x, 5)).alias("chain"),
        F.round("p_sc", 4).alias("p_sc"), F.round("p_vsc", 4).alias("p_vsc"), terms.alias("terms"), F.col("max_age"), F.col("boots"))).alias("doc")).unionByName(
        c.spark.createDataFrame([("_global", json.dumps(whole))], "circuit string, doc string"))


@query("d_14_replay_export", feat_sql(f"""
select race_no, drv, count(*) as laps, count(*) filter (where pit_in) as stops, count(*) filter (where rep) as rep_laps, arg_max(substr(compound, 1, 1), lap) as last_tyre,
  {R('max(t_end)', 2)} as last_clock from f where year = 2025 and dry_race group by all"""))
def replay_export(c):
    """Nested replay documents of the test season (one per car, chunked by lap block), written as JSON and read back."""
    letter = status_letter(F.col("sc"), F.col("vsc"), F.col("red"))
    lap = F.struct("lap", F.round("lap_time", 3).alias("time"), F.substring("compound", 1, 1).alias("tyre"), F.col("age"), letter.alias("status"),
                   F.col("pit_in").cast("int").alias("pit"), F.col("rep").cast("int").alias("rep"), F.round("t_end", 6).alias("t"), F.col("position").alias("pos"))
    f = c.laps.filter(F.col("dry_race") & F.col("year").isin(*TEST_YEARS))
    doc = f.groupBy("race_no", "drv", "blk").agg(F.first("driver").alias("driver"), F.sort_array(F.collect_list(lap)).alias("laps"))  # one block of laps
    back = c.memo("replay_json", lambda: round_trip(doc, "json", "replay-json"))
    x = back.select("race_no", "drv", F.explode("laps").alias("l")).select("race_no", "drv", "l.*")
    return x.groupBy("race_no", "drv").agg(F.count(F.lit(1)).alias("laps"), F.sum("pit").alias("stops"), F.sum("rep").alias("rep_laps"),
                                           F.max_by("tyre", "lap").alias("last_tyre"), rnd(F.max("t"), 2).alias("last_clock"))
