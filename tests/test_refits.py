"""Refits of replicates that hold a race at a time give what a row per lap and replicate gives, and write no such rows."""

import numpy as np
import pandas as pd
import pytest

from gridpace.operators import refits, ridge
from gridpace.operators.bundle import fit_laps


def _weights(spark, races, replicates=3):
    return ridge.bootstrap_weights(spark.createDataFrame([(int(r),) for r in races], "race_no bigint"), replicates)


@pytest.fixture(scope="module")
def both(ctx, spark):
    """The same fits on the laps of some races, one race without outliers and one whose car has nothing else."""
    pdf = fit_laps(ctx).filter("rep").select(*ridge.LAP_COLS).toPandas()
    one = (pdf.race_no == pdf.race_no.min()) & (pdf.drv == pdf[pdf.race_no == pdf.race_no.min()].drv.min())
    pdf.loc[one & (np.arange(len(pdf)) % 2 == 0), "lap_time"] += 90.0
    laps = spark.createDataFrame(pdf)
    w = _weights(spark, pdf.race_no.unique())
    written, whole = [], ridge.stage
    old, new = pytest.MonkeyPatch(), pytest.MonkeyPatch()
    old.setattr(refits, "RACE_LAPS", 0)
    a = ridge.fit(laps, weights=w, replicates=3)
    old.undo()

    def counted(df, name, *x, **k):
        got = whole(df, name, *x, **k)
        written.append(got.count())
        return got
    new.setattr(ridge, "stage", counted)
    new.setattr(refits, "stage", counted)
    b = ridge.fit(laps, weights=w, replicates=3)
    new.undo()
    return a, b, written, len(pdf)


def test_terms_scales_and_laps_are_the_same(both):
    a, b, _, _ = both
    assert sorted(a.shared) == sorted(b.shared) == [1, 2, 3] and a.n_laps == b.n_laps > 0
    for r in a.shared:
        assert np.allclose(a.shared[r], b.shared[r], rtol=1e-6, atol=1e-7) and abs(a.sigma[r] - b.sigma[r]) < 1e-7
    x, y = (m.circuits.toPandas().sort_values(["replicate", "circuit"]) for m in (a, b))
    assert (x[["replicate", "circuit"]].to_numpy() == y[["replicate", "circuit"]].to_numpy()).all()
    assert np.allclose(np.stack(x.circ_coef), np.stack(y.circ_coef), atol=1e-6)
    x, y = (m.local.toPandas().sort_values(["replicate", "race_no"]) for m in (a, b))
    assert len(x) == len(y) and all((p == q).all() for p, q in zip(x.cars, y.cars))
    for col in ("fe", "race_coef"):
        assert np.allclose(np.concatenate(list(x[col])), np.concatenate(list(y[col])), atol=1e-5)
    assert np.allclose(x.fe_default, y.fe_default, atol=1e-5)


def test_no_row_per_lap_and_replicate_is_written(both):
    _, b, written, laps = both
    assert laps < b.n_laps and max(written) < b.n_laps


def test_bins_keep_the_order_of_doubles():
    v = np.sort(np.array([-1e300, -2.0, -1e-9, 0.0, 1e-300, 0.5, 0.5000001, 3.0, 1e300]))
    assert (np.diff(refits._bins(v)) >= 0).all() and refits._bins(np.array([-1.0]))[0] < 0 <= refits._bins(np.array([0.0]))[0]


def test_a_car_without_laps_takes_the_median_base():
    rng = np.random.default_rng(2)
    n, car = 40, np.repeat([0, 1], 20)
    Z = np.column_stack([rng.random((n, ridge.P)), 80 + rng.random(n)])
    keep = np.column_stack([np.ones(n, bool), car == 0])
    system = refits._systems(*refits._kept_stats(Z, car, 2, keep), np.array([1.0, 2.0]), [0.6, 0.6])
    fe, _, middle = refits._local(system, np.zeros((2, ridge.NG)), np.zeros((2, ridge.NS - ridge.NG)))
    assert fe[1, 1] == middle[1] == fe[1, 0] and fe[0, 0] != fe[0, 1]
    for j, w in enumerate((1.0, 2.0)):
        m = keep[:, j]
        G, S, _ = refits._kept_stats(Z[m], car[m], int(car[m].max()) + 1, np.ones((int(m.sum()), 1), bool))
        want = ridge._race_system(G[0][ridge.TRI], list(range(S.shape[1])), S[0].ravel(), w, 0.6)
        assert np.allclose(system[2][j], want[2]) and np.allclose(system[4][j], want[4])
