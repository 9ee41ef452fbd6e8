"""Refits of a race from the laps seen so far, for every checkpoint, as a prefix scan over blocks of laps.

What a run of laps says is a small Gram matrix with its right-hand side. Two runs combine by fading the earlier one and
adding, which is associative. So every block of a race is folded on its own, the block sums of a race are scanned for what
lies before each block, and each block then extends that carry lap by lap and solves its own checkpoints. A task
holds one block's rows and one race's matrix, however long the race. Where every race is one block there is no carry, and the
laps are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpace.constants import DRY, IN_RACE_DEG_SD, IN_RACE_HALF_LIFE, PRIOR_SD
from gridpace.operators.ridge import LAP_COLS, Model

OUT = ("race_no bigint, k bigint, n_obs bigint, cars array<bigint>, fe array<double>, race_coef array<double>, fe_default double, "
       "extra array<double>")
OUT_COLS = ["race_no", "k", "n_obs", "cars", "fe", "race_coef", "fe_default", "extra"]
FIT_BLOCK = 512  # laps of a race that one task extends
SUMS = "race_no bigint, blk bigint, first bigint, last bigint, race_laps bigint, n bigint, cars array<bigint>, a array<double>, b array<double>"
CARRY = "race_no bigint, blk bigint, upto bigint, last bigint, n bigint, cars array<bigint>, a array<double>, b array<double>"


class _State:
    """Normal equations over FIXED unknowns and ``width`` more for each car seen, in the order in which cars came."""

    half_life: float | None = None

    def __init__(self, width: int):
        self.slot: dict[int, int] = {}
        self.width, self.lap, self.n = width, None, 0
        self.A, self.b = np.zeros((self.FIXED, self.FIXED)), np.zeros(self.FIXED)

    def slots(self, drv) -> np.ndarray:
        """Places of the cars; new ones get room."""
        s = np.array([self.slot.setdefault(int(d), len(self.slot)) for d in drv], np.int64)
        g = self.FIXED + self.width * len(self.slot) - len(self.b)
        if g:
            self.A, self.b = np.pad(self.A, (0, g)), np.pad(self.b, (0, g))
        return s

    def fade(self, lap: int) -> None:
        """Move on to ``lap``: what came before weighs less."""
        if self.lap is not None and lap > self.lap and self.half_life:
            f = 0.5 ** ((lap - self.lap) / self.half_life)
            self.A *= f
            self.b *= f
        self.lap = lap

    def absorb(self, last: int, n: int, cars, a, b) -> None:
        """Add the sums of the next run of laps, which ends at ``last``."""
        self.fade(int(last))
        at = self.FIXED + self.width * self.slots(cars)
        i = np.concatenate([np.arange(self.FIXED), (at[:, None] + np.arange(self.width)).ravel()]).astype(np.int64)
        self.A[np.ix_(i, i)] += np.asarray(a, float).reshape(len(i), len(i))
        self.b[i] += np.asarray(b, float)
        self.n += int(n)

    def sums(self) -> tuple:
        return self.lap, self.n, list(self.slot), self.A.ravel(), self.b


class LocalState(_State):
    """Decayed normal equations of base paces, race offsets and race wear rates, and optionally one wear rate per car and compound."""

    FIXED = 5  # off SOFT, off HARD, wear SOFT, wear MEDIUM, wear HARD

    def __init__(self, sigma: float, deg_sd: float | None, half_life: float | None, per_driver: bool = False):
        super().__init__(4 if per_driver else 1)
        self.half_life = half_life
        s2 = sigma ** 2
        deg = s2 / PRIOR_SD["deg_race"] ** 2 if deg_sd is None else s2 / max(deg_sd, 1e-6) ** 2
        off = s2 / PRIOR_SD["off_race"] ** 2
        self.lam = np.array([off, off, deg, deg, deg])
        self.lam_car = np.array([s2 / PRIOR_SD["fe"] ** 2] + ([s2 / PRIOR_SD["deg_drv"] ** 2] * 3 if per_driver else []))
        self.per_driver = per_driver

    def add(self, lap: int, r: pd.DataFrame | dict) -> None:
        self.fade(lap)
        s = self.slots(r["drv"])
        size = len(self.b)
        L, age, comp = r["l_scale"], r["age"] * r["l_scale"], r["comp"]
        X = np.zeros((len(s), size))
        X[:, 0], X[:, 1] = L * (comp == 0), L * (comp == 2)
        at, row = 5 + self.width * s, np.arange(len(s))
        X[row, at] = 1.0
        for c in range(3):
            X[:, 2 + c] = age * (comp == c)
            if self.per_driver:
                X[row, at + 1 + c] = X[:, 2 + c]
        self.A += X.T @ X
        self.b += X.T @ r["y"]
        self.n += len(s)

    def solve(self):
        M = self.A.copy()
        M[np.diag_indices(len(M))] += np.concatenate([self.lam, np.tile(self.lam_car, len(self.slot))])
        x = np.linalg.solve(M, self.b)
        cars = x[5:].reshape(len(self.slot), self.width)
        return self.n, list(self.slot), cars[:, 0], x[:5], float(np.median(cars[:, 0])), cars[:, 1:].ravel()


class LinearState(_State):
    """Plain linear baseline on a race's own laps: car and compound dummies, age per compound, lap number; ridge 0.1."""

    FIXED = 1 + len(DRY) + len(DRY) + 1  # intercept, compounds, ages, lap

    def __init__(self, alpha: float = 0.1):
        super().__init__(1)
        self.alpha = alpha

    def add(self, lap: int, r: dict) -> None:
        self.fade(lap)
        s = self.slots(r["drv"])
        size = len(self.b)
        X = np.zeros((len(s), size))
        X[:, 0] = 1.0
        for c in range(3):
            X[:, 1 + c] = r["comp"] == c
            X[:, 4 + c] = r["age"] * (r["comp"] == c)
        X[:, 7] = lap
        X[np.arange(len(s)), self.FIXED + s] = 1.0
        self.A += X.T @ X
        self.b += X.T @ r["y"]
        self.n += len(s)

    def solve(self):
        # the intercept is not penalised, which is the same as centring
        M = self.A.copy()
        pen = np.full(len(M), self.alpha)
        pen[0] = 0.0
        M[np.diag_indices(len(M))] += pen
        x = np.linalg.lstsq(M, self.b, rcond=None)[0]
        return self.n, list(self.slot), x[self.FIXED:], np.zeros(5), float(x[0]), x[:self.FIXED]


def _laps(pdf: pd.DataFrame):
    """(lap, columns of its rows) of rows sorted by lap."""
    arr = {c: pdf[c].to_numpy() for c in pdf.columns}
    edge = np.flatnonzero(np.r_[True, np.diff(arr["lap"]) != 0])
    for i, j in zip(edge, np.r_[edge[1:], len(pdf)]):
        yield int(arr["lap"][i]), {c: v[i:j] for c, v in arr.items()}


def _scanned(rows: DataFrame, make_state, step: int | None, last_lap: int | None) -> DataFrame:
    """One fit per checkpoint k of every race: every lap from the first observation on, or only multiples of ``step``.

    ``last_lap`` is the largest lap number of ``rows``.
    """
    key = ["race_no", "blk"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, s = pdf.sort_values(["lap", "drv"], kind="stable"), make_state()
        for lap, r in _laps(pdf):
            s.add(lap, r)
        return pd.DataFrame([(pdf["race_no"].iloc[0], pdf["blk"].iloc[0], pdf["lap"].iloc[0], s.lap, pdf["race_laps"].max(), *s.sums()[1:])],
                            columns=["race_no", "blk", "first", "last", "race_laps", "n", "cars", "a", "b"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Block sums of a race in order become what lies before each block, and the lap that its last fit holds up to."""
        race, state, held = None, None, None
        cols = ["race_no", "blk", "upto", "last", "n", "cars", "a", "b"]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.race_no == race:
                    out.append((race, held.blk, r.first - 1, *before))
                else:
                    if held is not None:
                        out.append((race, held.blk, held.race_laps, *before))
                    race, state = r.race_no, make_state()
                before = (state.lap if state.n else -1, state.n, list(state.slot), state.A.ravel().copy(), state.b.copy())
                state.absorb(r.last, r.n, r.cars, r.a, r.b)
                held = r
            if out:
                yield pd.DataFrame(out, columns=cols)
        if held is not None:
            yield pd.DataFrame([(race, held.blk, held.race_laps, *before)], columns=cols)

    def extend(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        s, c = make_state(), carry.iloc[0]
        if c["n"]:
            s.absorb(c["last"], c["n"], c["cars"], c["a"], c["b"])
        return checkpoints(pdf, s, int(c["upto"]))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        """A race of one block."""
        return checkpoints(pdf, make_state(), int(pdf["race_laps"].max()))

    def checkpoints(pdf: pd.DataFrame, s: _State, end: int) -> pd.DataFrame:
        race, seen, out = int(pdf["race_no"].iloc[0]), False, []

        def emit(upto: int):
            ks = [k for k in range(s.lap, upto + 1) if step is None or k % step == 0]
            if ks:
                fit = s.solve()
                out.extend((race, k, *fit) for k in ks)
        for lap, r in _laps(pdf.sort_values(["lap", "drv"], kind="stable")):
            if seen:
                emit(lap - 1)
            s.add(lap, r)
            seen = True
        emit(end)
        return pd.DataFrame(out, columns=OUT_COLS)
    if last_lap is None or last_lap <= FIT_BLOCK:
        return rows.groupBy("race_no").applyInPandas(whole, OUT)
    blocks = rows.groupBy(*key)
    carry = blocks.applyInPandas(fold, SUMS).repartition("race_no").sortWithinPartitions("race_no", "blk").mapInPandas(scan, CARRY)
    return blocks.cogroup(carry.groupBy(*key)).applyInPandas(extend, OUT)


def _last_lap(laps: DataFrame) -> int | None:
    return laps.agg(F.max("lap")).first()[0]


def _rows(laps: DataFrame, y) -> DataFrame:
    comp = F.expr("case compound when 'SOFT' then 0 when 'MEDIUM' then 1 when 'HARD' then 2 else -1 end")
    return laps.select("race_no", "lap", "drv", "race_laps", comp.alias("comp"), F.col("age").cast("double").alias("age"), "l_scale", y.alias("y"),
                       F.expr(f"(lap - 1) div {FIT_BLOCK}").alias("blk"))


def asof_local_fits(model: Model, rep_laps: DataFrame, deg_sd: float | None = IN_RACE_DEG_SD, half_life: float | None = IN_RACE_HALF_LIFE,
                    step: int | None = None, per_driver: bool = False) -> DataFrame:
    """Race-local terms as of every lap k (laps <= k only), shared terms held fixed; recent laps weigh more.

    With ``per_driver`` the column ``extra`` holds three wear deviations (SOFT, MEDIUM, HARD) per car, in the order of ``cars``.
    """
    g = model.predict_global(rep_laps.select(*LAP_COLS, "race_laps"))
    sigma = model.sigma[0]
    rows = _rows(g, F.col("lap_time") - F.col("pred_global"))
    out = _scanned(rows, lambda: LocalState(sigma, deg_sd, half_life, per_driver), step, _last_lap(rep_laps))
    return out if per_driver else out.drop("extra")


def asof_linear_fits(rep_laps: DataFrame, step: int = 5) -> DataFrame:
    """The plain linear baseline as of k = 5, 10, ..."""
    rows = _rows(rep_laps, F.col("lap_time"))
    return _scanned(rows, LinearState, step, _last_lap(rep_laps)).withColumnRenamed("fe_default", "intercept")


def linear_prediction():
    """Prediction of the plain linear baseline over lap columns and a fit row; an unseen car adds nothing."""
    c = F.expr("case compound when 'SOFT' then 0 when 'MEDIUM' then 1 when 'HARD' then 2 end")
    per = F.coalesce(F.get(F.col("extra"), c + 1) + F.get(F.col("extra"), c + 4) * F.col("age"), F.lit(0.0))
    car = F.coalesce(F.element_at(F.map_from_arrays("cars", "fe"), F.col("drv")), F.lit(0.0))
    return F.col("intercept") + per + F.get(F.col("extra"), F.lit(7)) * F.col("lap") + car
