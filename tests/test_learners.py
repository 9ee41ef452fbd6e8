"""The learners of the registered queries have the original study's sizes, and no score knows the season that it is of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpace.constants import DEV_YEARS, TRAIN_YEARS
from gridpace.operators import bundle
from gridpace.operators import forest as fo
from gridpace.operators import histboost as hb
from gridpace.plans import learning


class Asked(Exception):
    pass


def sizes(monkeypatch, ctx, run, module=hb):
    def ask(jobs, *a, **k):
        raise Asked({name: j.settings for name, j in jobs.items()})
    monkeypatch.setattr(module, "fit", ask)
    with pytest.raises(Asked) as e:
        run(ctx)
    monkeypatch.undo()
    return e.value.args[0]


def fresh(ctx):
    from gridpace.registry import Context
    c = Context(ctx.spark, ctx.sf_dir)
    c.shape, c.laps = ctx.shape, ctx.laps
    return c


def test_sizes_are_the_studys(ctx, monkeypatch):
    c = fresh(ctx)
    assert sizes(monkeypatch, c, learning.prerace_boosting) == {s: hb.Settings(600, 0.06, 63, 20) for s in ("dev", "test")}
    assert sizes(monkeypatch, c, learning.delta_boosters) == {"free": hb.Settings(500, 0.1, 31, 50), "rising": hb.Settings(500, 0.1, 31, 50, rising=("tyre_life",))}
    assert set(sizes(monkeypatch, c, learning.compound_models).values()) == {hb.Settings(100, 0.1, 31, 200, 5.0, 3, rising=("tyre_life",))}
    assert sizes(monkeypatch, c, learning.random_forest, fo) == {f"{t} {k}": fo.Size(100, 2) for t in ("lap_time", "delta") for k in ("raw", "standardised")}
    assert learning.CALL_SIZE == hb.Settings(800, 0.03, 31, 40, 1.0, loss="logistic") and learning.RESIDUAL_SIZE == hb.Settings(300, 0.05, 31, 20)


def test_a_compound_without_development_laps_reports_its_training_score(ctx):
    c = fresh(ctx)
    made = learning.study(c)[0]
    odd = made.withColumn("compound", F.when(F.col("compound") == "HARD", "WET").otherwise(F.col("compound")))
    few = made.limit(30).withColumn("compound", F.lit("RARE"))
    dev = learning.study(c)[1].filter("compound <> 'HARD'")
    c._made["enriched"] = odd.unionByName(few).unionByName(dev)
    got = {r["compound"]: r for r in learning.per_compound(c).collect()}
    assert got["WET"]["dev_n"] == 0 and got["WET"]["note"].startswith("no development laps") and got["WET"]["r2"] is not None and got["WET"]["tyre_coef"] is None
    assert got["RARE"]["note"] == "too few training laps" and got["RARE"]["r2"] is None
    assert got["SOFT"]["note"] == "" and got["SOFT"]["tyre_coef"] is not None
    assert {r["compound"] for r in learning.compound_curves(c).select("compound").distinct().collect()} == {"WET", "SOFT", "MEDIUM"}


def test_monotone_predictions_do_not_fall(ctx):
    got = {r["model"]: r for r in learning.monotone_scores(ctx).collect()}
    assert got["rising"]["deepest_fall"] == 0 and got["free"]["deepest_fall"] > 0 and set(got) == {"ridge", "free", "rising"}
    for _, g in learning.monotone(ctx).toPandas().sort_values("age").groupby("compound"):
        assert (np.diff(g.monotone_delta) >= 0).all()


def test_the_training_bundle_does_not_know_later_seasons(ctx):
    """Other lap times in 2024 and 2025 leave the bundle of 2021-23 and its coefficients as they are."""
    def coefficients(c):
        t = bundle.before_development(c)
        assert {r[0] for r in t.laps.select("year").distinct().collect()} <= {*TRAIN_YEARS, *DEV_YEARS}
        return bundle.model(t).shared[0]
    other = fresh(ctx)
    other.laps = ctx.laps.withColumn("lap_time", F.when(F.col("year").isin(*TRAIN_YEARS), F.col("lap_time")).otherwise(F.col("lap_time") * 1.3 + 5))
    assert np.array_equal(coefficients(ctx), coefficients(other))
    whole = bundle.model(ctx).shared[0]
    assert not np.allclose(whole, bundle.model(other).shared[0])
