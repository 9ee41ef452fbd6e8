"""Races of one block: the fits as of every lap take one shuffle of the laps, without a fold, a scan and a cogroup."""

import pytest

from gridpace.operators import asof_fit


@pytest.fixture
def race(spark):
    rows = [(r, lap, d, 25, "SOFT" if lap < 9 else "HARD", lap % 9 + 1, 1.0, 90.0 + 0.1 * d + 0.05 * lap + 0.01 * ((lap * 7 + d) % 5)) for r in (3, 4) for d in (1, 2, 7) for lap in range(2 + r, 22)]
    return spark.createDataFrame(rows, "race_no long, lap long, drv long, race_laps long, compound string, age long, l_scale double, lap_time double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_races_are_shuffled_once(race, monkeypatch):
    fits = asof_fit.asof_linear_fits(race)
    assert plan(fits).count("Exchange") == 1 and "CoGroup" not in plan(fits)
    got = {(r["race_no"], r["k"]): r for r in fits.collect()}
    assert sorted(got) == [(r, k) for r in (3, 4) for k in (5, 10, 15, 20, 25) if k >= 2 + r]
    monkeypatch.setattr(asof_fit, "FIT_BLOCK", 6)
    long = asof_fit.asof_linear_fits(race)
    assert "CoGroup" in plan(long)
    other = {(r["race_no"], r["k"]): r for r in long.collect()}
    assert got.keys() == other.keys()
    for k, r in got.items():
        assert (r["n_obs"], r["cars"]) == (other[k]["n_obs"], other[k]["cars"]) and r["intercept"] == pytest.approx(other[k]["intercept"], abs=1e-7)


def test_no_laps(race):
    assert asof_fit.asof_linear_fits(race.filter("false")).count() == 0
