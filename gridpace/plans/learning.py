"""Regression, boosting and classifier queries (M-08 .. M-23)."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpace.constants import DEV_YEARS, TEST_YEARS, TRAIN_YEARS
from gridpace.functions.expr import recency_weight
from gridpace.operators import bundle, decisions
from gridpace.operators import forest as fo
from gridpace.operators import histboost as hb
from gridpace.operators import linear as ln
from gridpace.operators import metrics as m
from gridpace.operators.enriched import CATEGORICAL, NUMERIC, enriched
from gridpace.operators.form import form_table
from gridpace.operators.quantile import group_quantile
from gridpace.plans.decide import inrace_forecasts
from gridpace.registry import query
from gridpace.session import stage

FIT = TRAIN_YEARS + DEV_YEARS
SWEEP = (1, 5, 10, 15, 20, 25, 30)


def years(df, ys):
    return df.filter(F.col("year").isin(*ys))


def with_form(c):
    """Representative laps with pre-race form and the structural model's driver base."""
    return c.memo("rep_form", lambda: stage(c.laps.filter("rep").join(form_table(c).drop("team"), ["race_no", "drv"], "left"), "rep-form"))


@query("m_08_prerace_base_model")
def prerace_base(c):
    """Ridge of fitted base paces on circuit, driver and team, recent seasons weighing more; plus the global lap terms."""
    rep = with_form(c)
    info = years(rep, FIT).groupBy("race_no", "drv").agg(*[F.first(x).alias(x) for x in ("circuit", "team", "driver", "year")])
    fe = bundle.local_terms(c).select("race_no", F.explode(F.map_from_arrays("cars", "fe")).alias("drv", "fe"))
    x = info.join(fe, ["race_no", "drv"]).withColumn("w", recency_weight(F.col("year"), F.lit(max(FIT)), 1.0))
    d = ln.design(x, [], ["circuit", "driver", "team"])
    b = ln.solve(ln.grams(x, d, "fe", weight="w")[()], 0.3)
    te = bundle.model(c).predict_global(years(rep, TEST_YEARS)).withColumn("p", F.col("pred_global") + ln.predict(d, b))
    return m.regression_metrics(te, ["year"], "lap_time", "p")


@query("m_09_one_hot_ridge_baseline")
def v1_ridge(c):
    tr, te = years(with_form(c), FIT), years(with_form(c), TEST_YEARS)
    d = ln.design(tr, ["age", "lap"], ["circuit", "driver", "compound"])
    b = ln.solve(ln.grams(tr, d, "lap_time")[()], 1.0)
    return m.regression_metrics(te.withColumn("p", ln.predict(d, b)), ["year"], "lap_time", "p")


# Numeric and categorical columns, and size of the study's pre-race booster.
PRE = ("year", "age", "fuel_kg", "lap_in_stint", "stint", "track_temp", "air_temp", "gap_ahead", "position", "team_form", "driver_form", "prev_ref")
PRE_CATEGORIES = ("circuit", "team", "driver", "compound")
PRE_SIZE = hb.Settings(rounds=600, step=0.06, leaves=63, least=20)
SPLITS = (("dev", TRAIN_YEARS, DEV_YEARS), ("test", FIT, TEST_YEARS))


@query("m_10_prerace_boosting")
def prerace_boosting(c):
    """Boosting on conditions and pre-race form: fitted before the development season and before the test season, scored on each."""
    rep = with_form(c)

    def make():
        return hb.fit({s: hb.Job(years(rep, fit), hb.Features.of(years(rep, fit), PRE, PRE_CATEGORIES), "lap_time", PRE_SIZE) for s, fit, _ in SPLITS})
    models = c.memo("prerace_boosters", make)
    p = scored([models[s].predict(years(rep, on)).select(F.lit(s).alias("split"), "lap_time", "prediction") for s, _, on in SPLITS if s in models])
    return m.regression_metrics(p, ["split"], "lap_time", "prediction")


# Columns and size of the study's booster of forecast errors, and the least gain on the development season that keeps it.
RESIDUAL = ("h", "age", "comp", "lap_in_stint", "gap_ahead", "position", "fuel_kg", "dtemp", "pitted_since", "n_obs", "k_frac", "l_scale")
RESIDUAL_SIZE = hb.Settings(rounds=300, step=0.05, leaves=31, least=20)
KEEP_BELOW = 0.99


@query("m_12_residual_booster")
def residual_booster(c):
    """Boost the structural forecast's residual. The rule keeps it if it is at least one per cent better on the development season.

    Bundle and booster of the development score know the training seasons only; those of the test score know the development season too.
    """
    def rows(ctx):
        return inrace_forecasts(ctx).filter("structural is not null").withColumn(
            "comp", F.expr("case compound when 'SOFT' then 0 when 'MEDIUM' then 1 else 2 end")).withColumn("resid", F.col("y") - F.col("structural"))
    known = {"dev": rows(bundle.before_development(c)), "test": rows(c)}

    def make():
        return hb.fit({s: hb.Job(years(known[s], fit), hb.Features(RESIDUAL), "resid", RESIDUAL_SIZE) for s, fit, _ in SPLITS})
    models = c.memo("residual_boosters", make)
    p = scored([models[s].predict(years(known[s], on)).select(F.lit(s).alias("split"), "y", "structural", (F.col("structural") + F.col("prediction")).alias("boosted"))
                for s, _, on in SPLITS if s in models])
    g = m.regression_metrics(p.unpivot(["split", "y"], ["structural", "boosted"], "model", "p"), ["split", "model"], "y", "p").select("split", "model", "n", "mae", "rmse")
    mae = lambda x: F.max(F.when((F.col("split") == "dev") & (F.col("model") == x), F.col("mae"))).over(Window.partitionBy(F.lit(0)))  # four rows
    return g.withColumn("keep_booster", mae("boosted") < KEEP_BELOW * mae("structural"))


def study(c):
    e = enriched(c)
    return years(e, TRAIN_YEARS), years(e, DEV_YEARS)


def scored(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


@query("m_13_weighted_one_hot_ridge")
def general_ridge(c):
    """Three linear studies: baseline, without driver, and with the lap number as a fuel proxy."""
    tr, dev = study(c)
    out = []
    for name, num, cat in (("baseline", ["tyre_life", "quarter"], ["compound", "driver", "bucket", "circuit"]), ("no_driver", ["tyre_life", "quarter"], ["compound", "bucket", "circuit"]),
                           ("fuel_proxy", ["tyre_life", "quarter", "lap"], ["compound", "driver", "bucket", "circuit"])):
        d = ln.design(tr, num, cat)
        b = ln.solve(ln.grams(tr, d, "lap_time")[()], 1.0)
        g = m.regression_metrics(dev.withColumn("p", ln.predict(d, b)), [], "lap_time", "p")
        out.append(g.select(F.lit(name).alias("study"), "n", "mae", "rmse", "r2", F.lit(float(b[1])).alias("tyre_coef")))
    return scored(out)


# Columns and size of the study's forests.
FOREST_NUMERIC, FOREST_CATEGORIES = ("tyre_life", "quarter", "lap"), ("compound", "driver", "bucket", "circuit")
FOREST_SIZE = fo.Size(trees=100, least=2)


@query("m_14_random_forest")
def random_forest(c):
    """Four forests: lap time and pace delta, raw and standardised columns. Scores on training and development laps, and importances.

    A split on one level of a category counts for that level. Standardised columns split alike, so their scores repeat the raw ones.
    """
    def make():
        tr, dev = (x.dropna(subset=FOREST_NUMERIC).select("race_no", "drv", "lap", "lap_time", "delta", "tyre_life", "quarter", *FOREST_CATEGORIES) for x in study(c))
        s = tr.agg(*[f(x).alias(f"{x}_{k}") for x in FOREST_NUMERIC for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        z = {x: (F.col(x) - s[f"{x}_m"]) / (s[f"{x}_s"] or 1.0) for x in FOREST_NUMERIC}
        f = hb.Features.of(tr, FOREST_NUMERIC, singles=FOREST_CATEGORIES)
        jobs, rows = {}, {}
        for target in ("lap_time", "delta"):
            for kind, scale in (("raw", lambda d: d), ("standardised", lambda d: d.withColumns(z))):
                name = f"{target} {kind}"
                known = {k: scale(d.withColumn("lap_key", F.col("lap")).filter(F.col(target).isNotNull())).withColumns({"part": F.lit(k), "y": F.col(target)}) for k, d in (("train", tr), ("dev", dev))}
                jobs[name], rows[name] = hb.Job(known["train"], f, target, FOREST_SIZE), known["train"].unionByName(known["dev"])
        mod = fo.fit(jobs)
        g = m.regression_metrics(mod.predict(rows, ["part", "race_no", "drv", "lap_key", "y"]), ["fit", "part"], "y", "prediction")
        items = F.explode(F.array(*[F.struct(F.concat("part", F.lit(f"_{n}")).alias("item"), e.alias("value")) for n, e in (("r2", F.col("r2")), ("mse", F.col("rmse") * F.col("rmse")), ("laps", F.col("n").cast("double")))])).alias("i")
        imp = mod.importances().select("fit", F.concat(F.lit("importance_"), "feature").alias("item"), F.col("importance").alias("value"))
        return stage(g.select("fit", items).select("fit", "i.item", "i.value").unionByName(imp), "forests")
    return c.memo("forests", make)


# Size of the study's boosted models of the pace delta, of all compounds together and of one compound, and of a
# compound without development laps; least training laps of a compound.
DELTA_SIZE = dict(rounds=500, least=50)
COMPOUND_SIZE = dict(rounds=100, least=200, depth=3, l2=5.0)
UNCHECKED_SIZE = dict(rounds=100, least=30, depth=3, l2=5.0)
LEAST_LAPS = 100
ONE_COMPOUND = ("bucket", "circuit", "clean_air")


def complete(df):
    """Laps with a pace delta and all numeric study columns."""
    return df.filter("delta is not null").dropna(subset=NUMERIC)


def delta_boosters(c):
    """The study's boosted models of the pace delta, shared by the read-outs below: free, and never falling with tyre age."""
    def make():
        tr = complete(study(c)[0])
        f = hb.Features.of(tr, NUMERIC, singles=CATEGORICAL)
        return hb.fit({"free": hb.Job(tr, f, "delta", hb.Settings(**DELTA_SIZE)), "rising": hb.Job(tr, f, "delta", hb.Settings(**DELTA_SIZE, rising=("tyre_life",)))})
    return c.memo("delta_boosters", make)


def age_sweep(model, rows, out="median_delta"):
    """Predicted delta of every row at each swept tyre age, medians per compound."""
    s = rows.withColumn("tyre_life", F.explode(F.array(*[F.lit(x).cast("bigint") for x in SWEEP])))
    p = model.predict(s.select("compound", "tyre_life", *[x for x in model.features.names if x not in ("compound", "tyre_life")]))
    p = p.select("compound", F.col("tyre_life").alias("age"), "prediction")
    return group_quantile(p, ["compound", "age"], F.col("prediction"), 0.5, out)


@query("m_15_monotone_age_curve")
def monotone(c):
    """Age curves of the booster that may not fall with tyre age, beside those of the free one."""
    dev, models = complete(study(c)[1]), delta_boosters(c)
    return age_sweep(models["free"], dev).join(age_sweep(models["rising"], dev, "monotone_delta"), ["compound", "age"])


@query("m_15_monotone_scores")
def monotone_scores(c):
    """Ridge, free and monotone boosting on the development laps, and how far any single lap's prediction falls from one swept age to the next."""
    tr, dev = (complete(x) for x in study(c))
    models = delta_boosters(c)
    d = ln.design(tr, NUMERIC, CATEGORICAL)
    p = dev.withColumn("ridge", ln.predict(d, ln.solve(ln.grams(tr, d, "delta")[()], 1.0)))
    for name, mod in models.items():
        p = mod.predict(p, name)
    g = m.regression_metrics(p.unpivot(["delta"], ["ridge", *models], "model", "p"), ["model"], "delta", "p").select("model", "n", "r2", "mae")
    drops = []
    for name, mod in models.items():
        s = dev.select("race_no", "drv", "lap", *[x for x in mod.features.names if x not in ("lap", "tyre_life")], F.explode(F.array(*[F.lit(x).cast("bigint") for x in SWEEP])).alias("tyre_life"))
        one = mod.predict(s).groupBy("race_no", "drv", "lap").agg(F.sort_array(F.collect_list(F.struct("tyre_life", "prediction")))["prediction"].alias("v"))  # seven ages
        fall = F.array_max(F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i - 1) - F.get("v", i)))
        drops.append(one.agg(F.lit(name).alias("model"), F.greatest(F.max(fall), F.lit(0.0)).alias("deepest_fall")))
    return g.join(scored(drops), "model", "left")


def compound_models(c):
    """Per compound: training and development laps, and the boosted model where there are LEAST_LAPS training laps; all fitted in one job."""
    def make():
        tr, dev = (stage(x.filter("delta is not null"), "compound-laps") for x in study(c))
        n = {s: {r["compound"]: r["n"] for r in x.groupBy("compound").agg(F.count(F.lit(1)).alias("n")).collect()} for s, x in (("train", tr), ("dev", dev))}  # the tyre compounds
        jobs = {}
        for comp, k in n["train"].items():
            if comp is not None and k >= LEAST_LAPS:
                mine = tr.filter(F.col("compound") == comp).dropna(subset=NUMERIC)
                size = hb.Settings(**COMPOUND_SIZE, rising=("tyre_life",)) if comp in n["dev"] else hb.Settings(**UNCHECKED_SIZE)
                jobs[comp] = hb.Job(mine, hb.Features.of(mine, NUMERIC, singles=ONE_COMPOUND), "delta", size)
        return tr, dev, n, hb.fit(jobs) if jobs else {}
    return c.memo("compound_models", make)


@query("m_16_per_compound_models")
def per_compound(c):
    """Per compound: the boosted model's score on development laps and the ridge's wear rate. Without development laps the score is of the training laps."""
    tr, dev, n, models = compound_models(c)
    d = ln.design(tr, NUMERIC, ONE_COMPOUND)
    grams = ln.grams(tr, d, "delta", ["compound"])
    rows, frames = [], []
    for comp, k in sorted((x for x in n["train"].items() if x[0] is not None)):
        checked = comp in n["dev"]
        note = "too few training laps" if k < LEAST_LAPS else "" if checked else "no development laps: training score"
        coef = float(ln.solve(grams[(comp,)], 1.0)[1]) if comp in models and checked and (comp,) in grams else None
        rows.append((comp, k, n["dev"].get(comp, 0), coef, note))
        if comp in models:
            frames.append(models[comp].predict((dev if checked else tr).filter(F.col("compound") == comp).dropna(subset=NUMERIC)).select("compound", "delta", "prediction"))
    out = c.spark.createDataFrame(rows, "compound string, train_n long, dev_n long, tyre_coef double, note string")
    if not frames:
        return out.select("*", *[F.lit(None).cast("double").alias(x) for x in ("r2", "mae")])
    return out.join(m.regression_metrics(scored(frames), ["compound"], "delta", "prediction").select("compound", "r2", "mae"), "compound", "left")


@query("m_16_per_compound_age_curves")
def compound_curves(c):
    """Median predicted delta of each compound's own model at the seven swept ages, on its development laps, else on its training laps."""
    tr, dev, n, models = compound_models(c)
    curves = [age_sweep(mod, (dev if comp in n["dev"] else tr).filter(F.col("compound") == comp).dropna(subset=NUMERIC)) for comp, mod in sorted(models.items())]
    return scored(curves) if curves else c.spark.createDataFrame([], "compound string, age bigint, median_delta double")


@query("m_17_partial_dependence_sweep")
def sweep(c):
    return age_sweep(delta_boosters(c)["free"], complete(study(c)[1]))


def shuffled(base, key, repeats: int, n_buckets: int):
    """Every row of ``base`` with the ``x`` of another row of its bucket as ``z``, once per repeat."""
    h = lambda tag, rep: F.xxhash64(F.lit(tag), rep, *key)
    r = base.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    r = r.withColumn("b", F.pmod(h("bucket", F.col("repeat")), F.lit(n_buckets)))
    w = Window.partitionBy("repeat", "b")
    left = r.withColumn("rn", F.row_number().over(w.orderBy(h("left", F.col("repeat")), *key)))
    right = r.withColumn("rn", F.row_number().over(w.orderBy(h("right", F.col("repeat")), *key))).select("repeat", "b", "rn", F.col("x").alias("z"))
    # Spark takes the repeats for as small as the file that they come from and would send all of them through the driver
    return left.join(right.hint("merge"), ["repeat", "b", "rn"])


@query("m_18_permutation_importance")
def permutation(c, repeats: int = 10, bucket_rows: int = 8192):
    """Score drop when one column is shuffled. Rows are shuffled inside hash buckets of bounded size, by joining two orders."""
    mod = delta_boosters(c)["free"]
    base = complete(study(c)[1]).select("race_no", "drv", "lap", "delta", mod.features.array().alias("x"))
    base = stage(base, "perm-base")
    n_buckets = max(1, base.count() // bucket_rows)
    j = shuffled(base, ("race_no", "drv", "lap"), repeats, n_buckets)
    names = F.array(*[F.lit(n) for n in mod.features.names])
    mix = j.select("repeat", "delta", "x", "z", F.explode(F.sequence(F.lit(0), F.lit(len(mod.features.names) - 1))).alias("f")).select(
        "repeat", "f", "delta", F.transform("x", lambda v, i: F.when(i == F.col("f"), F.get("z", i)).otherwise(v)).alias("x"))
    got = m.regression_metrics(mod.predict(mix, features=F.col("x")), ["repeat", "f"], "delta", "prediction")
    whole = m.regression_metrics(mod.predict(base, features=F.col("x")), [], "delta", "prediction").first()["r2"]
    return got.groupBy(F.get(names, F.col("f")).alias("feature")).agg(F.avg(F.lit(whole) - F.col("r2")).alias("importance"), F.count(F.lit(1)).alias("repeats"))


@query("m_19_standardised_ridge")
def standardised(c):
    """Numeric columns scaled by training mean and population deviation; coefficients brought back to raw units."""
    tr, dev = study(c)
    num, cat = ["tyre_life", "quarter", "lap"], ["compound", "driver", "bucket", "circuit"]
    s = tr.agg(*[f(x).alias(f"{x}_{k}") for x in num for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = lambda df: df.withColumns({x: (F.col(x) - s[f"{x}_m"]) / s[f"{x}_s"] for x in num})
    d = ln.design(tr, num, cat)
    b = ln.solve(ln.grams(z(tr), d, "lap_time")[()], 1.0)
    raw = ln.solve(ln.grams(tr, d, "lap_time")[()], 1.0)
    r2 = m.regression_metrics(z(dev).withColumn("p", ln.predict(d, b)), [], "lap_time", "p").first()["r2"]
    rows = [(x, float(b[1 + i]), float(b[1 + i] / s[f"{x}_s"]), float(raw[1 + i]), float(r2)) for i, x in enumerate(num)]
    return c.spark.createDataFrame(rows, "feature string, scaled_coef double, raw_unit_coef double, unscaled_fit_coef double, dev_r2 double")


@query("m_20_alpha_sweep")
def alpha_sweep(c, folds: int = 5):
    """Twelve penalties scored by cross-validation: one Gram per fold, hold-outs by subtraction."""
    tr, _ = study(c)
    d = ln.design(tr, ["tyre_life", "quarter", "lap"], ["compound", "driver", "bucket", "circuit"])
    g = ln.grams(tr.withColumn("fold", F.pmod(F.xxhash64("race_no", "drv", "lap"), F.lit(folds))), d, "lap_time", ["fold"])
    total = sum(g.values())
    rows = []
    for alpha in np.logspace(-2, 3, 12):
        err = sum(ln.sse(G, ln.solve(total - G, alpha)) for G in g.values()) / total[0, 0]
        rows.append((float(alpha), float(err)))
    best = min(rows, key=lambda r: r[1])[0]
    return c.spark.createDataFrame([(a, e, a == best) for a, e in rows], "alpha double, cv_mse double, best boolean")


# Columns of the study's four families of pit-call models, and the size of each.
BASIC = ["age", "comp", "lap_frac", "laps_left", "stops_before", "two_compounds", "status", "position_prev", "gap_ahead_prev", "pit_loss", "race_laps", "track_temp"]
CONTEXT = BASIC + ["age_ratio", "cars_stopped_prev", "ahead_stopped_prev", "behind_stopped_prev", "ahead_age_diff", "behind_age_diff", "mate_stopped_prev",
                   "rejoin_positions_lost", "rejoin_gap", "field_stopped_frac", "pace_drop", "gap_behind_prev", "field_age_diff", "stops_lag1", "stops_lag2",
                   "stops_recent3", "near_stops2", "same_comp_frac_stopped"]
FAMILIES = {"basic": BASIC, "context": CONTEXT, "hybrid": CONTEXT + ["dp_gain", "dp_gain_pre", "dp_pit", "laps_to_plan", "plan_stops"], "leaky": BASIC + ["lap_delta_leaky"]}
CALL_SIZE = hb.Settings(rounds=800, step=0.03, leaves=31, least=40, l2=1.0, loss="logistic")


def scored_calls(c):
    """Every state of the development and the test season with each family's probability, and the call at the threshold that the development season froze.

    The development models and their optimiser columns know the training seasons only; the test models are fitted again with the development season.
    """
    def make():
        known = {"dev": decisions.decisions(bundle.before_development(c)), "test": decisions.decisions(c)}
        jobs = {f"{s} {name}": hb.Job(years(known[s], fit), hb.Features(tuple(feats)), "y", CALL_SIZE) for s, fit, _ in SPLITS for name, feats in FAMILIES.items()}
        models = hb.fit(jobs)
        p = scored([models[f"{s} {name}"].predict(years(known[s], on), "p").select(F.lit(s).alias("split"), F.lit(name).alias("family"), "race_no", "drv", "lap", "stint", "y", "status", "p")
                    for s, _, on in SPLITS for name in FAMILIES if f"{s} {name}" in models])
        p = stage(p, "call-scores")
        best = m.threshold_table(p.filter("split = 'dev'"), keys=["family"]).groupBy("family").agg(F.max_by("threshold", F.struct("f1", -F.col("i"))).alias("threshold"))
        return stage(p.join(F.broadcast(best), "family").withColumn("call", (F.col("p") >= F.col("threshold")).cast("int")), "calls")  # four rows
    return c.memo("scored_calls", make)


@query("m_21_pit_call_classifiers")
def classifiers(c):
    """Four feature families scored on the development and the test season, at thresholds frozen on the development season."""
    s, by = scored_calls(c), ["split", "family"]
    cls = m.classification(s, by).select(*by, "precision", "recall", "f1")
    rank = m.ranking_metrics(m.score_steps(s, keys=by), by)
    tol = [m.tolerant(s, by, k).select(*by, F.col("f1").alias(f"f1_within_{k}")) for k in (1, 2)]
    first = m.first_call_summary(m.first_call_errors(s, by), by).select(*by, "stints", "never_called", "within_2_laps")
    neu = m.neutral_metrics(s, by).select(*by, "balanced_accuracy")
    size = s.groupBy(*by).agg(F.count(F.lit(1)).alias("states"), F.first("threshold").alias("threshold"))
    return reduce(lambda x, y: x.join(y, by, "left"), [cls, size, rank, *tol, first, neu])


@query("m_23_explicit_equations")
def equations(c):
    """Lap time = tyre age + fuel (laps remaining) + car and circuit controls, per compound and combined; green laps only."""
    tr, dev = (x.filter("bucket = 'green'") for x in study(c))
    num = ["tyre_life", "laps_remaining", "team_pace"]
    rows = []
    for scope, cats, keys in (("per compound", ["circuit"], ["compound"]), ("combined", ["circuit", "compound"], [])):
        d = ln.design(tr, num, cats)
        gt, gd = ln.grams(tr, d, "lap_time", keys), ln.grams(dev, d, "lap_time", keys)
        for k, G in sorted(gt.items()):
            if G[0, 0] < 100:
                continue
            b = ln.solve(G, 1.0)
            E = gd.get(k)
            r2 = float(1 - ln.sse(E, b) / (E[-1, -1] - E[0, -1] ** 2 / E[0, 0])) if E is not None else None
            rows += [(scope, k[0] if k else "all", n, float(v), int(G[0, 0]), r2) for n, v in zip(["intercept", *d.names], b) if n in ("intercept", *num) or n.startswith("compound=")]
    return c.spark.createDataFrame(rows, "scope string, compound string, term string, coef double, train_n long, dev_r2 double")
