"""Hierarchical ridge model of lap time, fitted from per-race sufficient statistics.

Race-local coefficients (base pace per car, race offsets, race wear rates) of
different races never meet, so the penalised normal equations have an arrow
shape at two levels: every race is eliminated on its own (Schur complement) and
the reduced systems are added up by circuit; every circuit's 5 unknowns are
eliminated in a task in the same way, so that 32 unknowns are left for the
driver to solve, per replicate; circuits and races are then back-substituted in
tasks. This is exact, and nothing on the driver grows with races or circuits.

Laps are read once per pass and only folded into per-(race, car) sums; the
fitted model is a set of coefficient tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpace.constants import DRY, FIRST_PASS_SIGMA, KNOTS, OFFSET_COMPOUNDS, PRIOR_SD
from gridpace.functions.expr import hinge
from gridpace.operators.gram import FLUSH_KEYS, sum_arrays
from gridpace.operators.quantile import group_quantile
from gridpace.session import stage

NK = len(KNOTS)
LAP_COLS = ["race_no", "drv", "circuit", "lap_time", "compound", "age", "l_scale", "fuel_kg", "track_temp", "lap_in_stint",
            "gap1", "gap2", "lap", "stint"]

# one base column per physical effect; several coefficients may share a column
BASE = ([("fuel", "fuel")] + [("off", c) for c in OFFSET_COMPOUNDS]
        + [("deg0" if j == 0 else "deg", f"{c}:{j}") for c in DRY for j in range(NK)]
        + [("temp", c) for c in DRY] + [("wear", c) for c in DRY] + [("cold", c) for c in DRY]
        + [("traffic", "gap1"), ("traffic", "gap2")] + [("early", k) for k in ("lap2", "lap3", "stint1")])
P = len(BASE)
OFF = [i for i, (b, _) in enumerate(BASE) if b == "off"]
WEAR = [i for i, (b, _) in enumerate(BASE) if b == "wear"]
GLOBAL = [("off_g" if b == "off" else b, k, i) for i, (b, k) in enumerate(BASE) if b != "wear"]
CIRC = [("off_circ", k, i) for i, k in zip(OFF, OFFSET_COMPOUNDS)] + [("deg_circ", k, i) for i, k in zip(WEAR, DRY)]
RACE = [("off_race", k, i) for i, k in zip(OFF, OFFSET_COMPOUNDS)] + [("deg_race", k, i) for i, k in zip(WEAR, DRY)]
SHARED_IX = [i for *_, i in GLOBAL] + [i for *_, i in CIRC]
RACE_IX = [i for *_, i in RACE]
NG, NS, NR = len(GLOBAL), len(SHARED_IX), len(RACE_IX)
TRI = np.triu_indices(P + 1)
BROADCAST_CIRCUITS = 10_000  # circuits x replicates (5 numbers each) sent to every task; more are shuffled


def base_matrix(pdf: pd.DataFrame) -> np.ndarray:
    """The base columns of a batch of laps."""
    L = pdf["l_scale"].to_numpy(float)
    age = pdf["age"].to_numpy(float)
    comp = pdf["compound"].to_numpy(object)
    X = np.zeros((len(pdf), P))
    X[:, 0] = pdf["fuel_kg"].to_numpy(float) * L
    mask = {c: comp == c for c in DRY}
    for i, c in zip(OFF, OFFSET_COMPOUNDS):
        X[:, i] = L * mask[c]
    basis = np.maximum(age[:, None] - np.array(KNOTS, float), 0.0) * L[:, None]
    temp = (pdf["track_temp"].to_numpy(float) - 35.0) / 10.0
    second = pdf["lap_in_stint"].to_numpy() == 2
    for ci, c in enumerate(DRY):
        X[:, 3 + ci * NK: 3 + (ci + 1) * NK] = basis * mask[c][:, None]
        X[:, 3 + 3 * NK + ci] = age * temp * L * mask[c]
        X[:, WEAR[ci]] = age * L * mask[c]
        X[:, WEAR[-1] + 1 + ci] = L * (mask[c] & second)
    t = WEAR[-1] + 4
    X[:, t], X[:, t + 1] = pdf["gap1"].to_numpy(float) * L, pdf["gap2"].to_numpy(float) * L
    lap = pdf["lap"].to_numpy()
    X[:, t + 2], X[:, t + 3] = L * (lap == 2), L * (lap == 3)
    X[:, t + 4] = L * (pdf["stint"].to_numpy() == 1)
    return X


STATS = "replicate int, race_no bigint, circuit string, xx array<double>, cars array<bigint>, sums array<double>"
W1 = P + 2  # per car: lap count, base-column sums, lap-time sum


def _fold_races(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    acc: dict[tuple, list] = {}

    def flush():
        rows = []
        for (rep, race, circ), (xx, cars) in acc.items():
            ds = sorted(cars)
            rows.append((rep, race, circ, xx[TRI], ds, np.concatenate([cars[d] for d in ds])))
        acc.clear()
        return pd.DataFrame(rows, columns=["replicate", "race_no", "circuit", "xx", "cars", "sums"])
    for pdf in batches:
        Z = np.column_stack([base_matrix(pdf), pdf["lap_time"].to_numpy(float)])
        for key, ix in pdf.groupby(["replicate", "race_no", "circuit"], sort=False).indices.items():
            z = Z[ix]
            xx, cars = acc.setdefault(key, [np.zeros((P + 1, P + 1)), {}])
            xx += z.T @ z
            drv = pdf["drv"].to_numpy()[ix]
            uniq, inv = np.unique(drv, return_inverse=True)
            one = np.zeros((len(uniq), W1))
            np.add.at(one, inv, np.column_stack([np.ones(len(ix)), z]))
            for d, v in zip(uniq, one):
                cars[int(d)] = cars[int(d)] + v if int(d) in cars else v
        if len(acc) > FLUSH_KEYS:
            yield flush()
    if acc:
        yield flush()


def _merge_races(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream partial race statistics sorted by race; one race is held at a time."""
    cur, xx, cars, out = None, None, {}, []

    def row():
        ds = sorted(cars)
        return (*cur, xx, ds, np.concatenate([cars[d] for d in ds]))
    cols = ["replicate", "race_no", "circuit", "xx", "cars", "sums"]
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            key = (r.replicate, r.race_no, r.circuit)
            if key != cur:
                if cur is not None:
                    out.append(row())
                cur, xx, cars = key, np.zeros(len(TRI[0])), {}
            xx = xx + np.asarray(r.xx, float)
            for d, v in zip(r.cars, np.asarray(r.sums, float).reshape(-1, W1)):
                cars[d] = cars[d] + v if d in cars else v
        if len(out) >= FLUSH_KEYS:
            yield pd.DataFrame(out, columns=cols)
            out = []
    if cur is not None:
        out.append(row())
    if out:
        yield pd.DataFrame(out, columns=cols)


def race_stats(laps: DataFrame, salts: int = 16) -> DataFrame:
    """Sufficient statistics per (replicate, race): cross-products of the base columns and per-car sums."""
    cols = [c for c in LAP_COLS]
    part = laps.select("replicate", *cols).mapInPandas(_fold_races, STATS)
    key = ["replicate", "race_no"]
    salted = part.withColumn("_salt", F.spark_partition_id() % salts)
    one = (salted.repartition(*key, "_salt").sortWithinPartitions(*key, "circuit", "_salt").drop("_salt").mapInPandas(_merge_races, STATS))
    return one.repartition(*key).sortWithinPartitions(*key, "circuit").mapInPandas(_merge_races, STATS)


def _penalties(sigma: float) -> tuple[np.ndarray, np.ndarray, float]:
    lam = lambda block: sigma ** 2 / PRIOR_SD[block] ** 2
    shared = np.array([lam(b) for b, *_ in GLOBAL + CIRC])
    return shared, np.array([lam(b) for b, *_ in RACE]), lam("fe")


def _race_system(xx, cars, sums, w: float, sigma: float):
    """Local-local, local-shared and shared-shared blocks of one race, weighted by its multiplicity."""
    G = np.zeros((P + 1, P + 1))
    G[TRI] = xx
    G = G + G.T - np.diag(np.diag(G))
    D = len(cars)
    S = np.asarray(sums, float).reshape(D, W1)
    n, sx, sy = S[:, 0], S[:, 1:1 + P], S[:, -1]
    _, lam_r, lam_fe = _penalties(sigma)
    ll = np.zeros((D + NR, D + NR))
    ll[:D, :D] = np.diag(w * n + lam_fe)
    ll[:D, D:] = w * sx[:, RACE_IX]
    ll[D:, :D] = ll[:D, D:].T
    ll[D:, D:] = w * G[np.ix_(RACE_IX, RACE_IX)] + np.diag(lam_r)
    ls = w * np.vstack([sx[:, SHARED_IX], G[np.ix_(RACE_IX, SHARED_IX)]])
    ss = w * G[np.ix_(SHARED_IX, SHARED_IX)]
    bl = w * np.concatenate([sy, G[RACE_IX, P]])
    bs = w * G[SHARED_IX, P]
    return ll, ls, ss, bl, bs


def _reduce(sigmas: dict[int, float]):
    def run(batches):
        acc: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.w == 0:
                    continue
                ll, ls, ss, bl, bs = _race_system(r.xx, r.cars, r.sums, r.w, sigmas[r.replicate])
                sol = np.linalg.solve(ll, np.column_stack([ls, bl]))
                red = np.column_stack([ss - ls.T @ sol[:, :-1], bs - ls.T @ sol[:, -1]]).ravel()
                k = (r.replicate, r.circuit)
                acc[k] = acc[k] + red if k in acc else red
            if len(acc) > FLUSH_KEYS:
                yield pd.DataFrame([(*k, v) for k, v in acc.items()], columns=["replicate", "circuit", "red"])
                acc.clear()
        if acc:
            yield pd.DataFrame([(*k, v) for k, v in acc.items()], columns=["replicate", "circuit", "red"])
    return run


LOCAL = "replicate int, race_no bigint, cars array<bigint>, fe array<double>, race_coef array<double>, fe_default double"


def _back_substitute(sigmas: dict[int, float], shared: dict[int, np.ndarray]):
    """Race-local terms of races that carry their circuit's terms in ``circ_coef``."""
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.w == 0:
                    continue
                circ = np.zeros(NS - NG) if r.circ_coef is None else np.asarray(r.circ_coef, float)
                ll, ls, _, bl, _ = _race_system(r.xx, r.cars, r.sums, r.w, sigmas[r.replicate])
                b = np.linalg.solve(ll, bl - ls @ np.concatenate([shared[r.replicate], circ]))
                D = len(r.cars)
                out.append((r.replicate, r.race_no, r.cars, b[:D], b[D:], float(np.median(b[:D]))))
            yield pd.DataFrame(out, columns=["replicate", "race_no", "cars", "fe", "race_coef", "fe_default"])
    return run


CIRCUITS = "replicate int, circuit string, circ_coef array<double>"


def _circuit_system(red, sigma: float):
    """Global-global, global-circuit and circuit-circuit blocks of one circuit's reduced system, the last with its penalties."""
    M = np.asarray(red, float).reshape(NS, NS + 1)
    lam, _, _ = _penalties(sigma)
    return M[:NG, :NG], M[:NG, NG:NS], M[NG:, NG:NS] + np.diag(lam[NG:]), M[:NG, NS], M[NG:, NS]


def _eliminate_circuits(sigmas: dict[int, float]):
    def run(batches):
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                gg, gc, cc, bg, bc = _circuit_system(r.red, sigmas[r.replicate])
                sol = np.linalg.solve(cc, np.column_stack([gc.T, bc]))
                v = np.column_stack([gg - gc @ sol[:, :NG], bg - gc @ sol[:, NG]]).ravel()
                acc[r.replicate] = acc[r.replicate] + v if r.replicate in acc else v
        if acc:
            yield pd.DataFrame([(k, v) for k, v in acc.items()], columns=["replicate", "red"])
    return run


def _substitute_circuits(sigmas: dict[int, float], shared: dict[int, np.ndarray]):
    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                _, gc, cc, _, bc = _circuit_system(r.red, sigmas[r.replicate])
                out.append((r.replicate, r.circuit, np.linalg.solve(cc, bc - gc.T @ shared[r.replicate])))
            yield pd.DataFrame(out, columns=["replicate", "circuit", "circ_coef"])
    return run


def solve_shared(reduced: DataFrame, sigmas: dict[int, float]) -> tuple[dict[int, np.ndarray], DataFrame]:
    """The 32 global terms of each replicate, and the table of circuit terms, from reduced systems (replicate, circuit, red)."""
    part = reduced.mapInPandas(_eliminate_circuits(sigmas), "replicate int, red array<double>")
    shared = {}
    for r in sum_arrays(part, ["replicate"], ["red"]).collect():  # 32 x 33 numbers per replicate
        M = np.array(r["red"], float).reshape(NG, NG + 1)
        lam, _, _ = _penalties(sigmas[r["replicate"]])
        shared[r["replicate"]] = np.linalg.solve(M[:, :NG] + np.diag(lam[:NG]), M[:, NG])
    return shared, reduced.mapInPandas(_substitute_circuits(sigmas, shared), CIRCUITS)


def short(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose counted ``rows`` are few; Spark shuffles a longer one."""
    return F.broadcast(table) if rows <= BROADCAST_CIRCUITS else table


@dataclass
class Model:
    """A fitted model. ``shared`` holds 32 numbers per replicate; circuit terms (replicate, circuit, circ_coef) and race-local terms are tables."""

    spark: SparkSession
    shared: dict[int, np.ndarray]
    circuits: DataFrame
    n_circuits: int  # rows of ``circuits``
    local: DataFrame
    sigma: dict[int, float]
    n_laps: int = 0
    laps: DataFrame | None = field(default=None, repr=False)

    def coef(self, block: str, key: str, rep: int = 0) -> float:
        for i, (b, k, _) in enumerate(GLOBAL):
            if (b, k) == (block, key):
                return float(self.shared[rep][i])
        if block in ("off_circ", "deg_circ"):
            c, comp = key.split("|")
            j = [(b, k) for b, k, _ in CIRC].index((block, comp))
            row = self.circuits.filter((F.col("replicate") == rep) & (F.col("circuit") == c)).first()
            return float(row["circ_coef"][j]) if row else 0.0
        return 0.0

    def shared_table(self) -> DataFrame:
        """(replicate, block, circuit, key, value); circuit is null for global terms."""
        rows = [(rep, b, None, k, float(v)) for rep, g in self.shared.items() for (b, k, _), v in zip(GLOBAL, g)]
        terms = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(k).alias("key"), F.col("circ_coef")[i].alias("value")) for i, (b, k, _) in enumerate(CIRC)])).alias("x")
        circ = self.circuits.select("replicate", "circuit", terms).select("replicate", "x.block", "circuit", "x.key", "x.value")
        return self.spark.createDataFrame(rows, "replicate int, block string, circuit string, key string, value double").unionByName(circ)

    def local_table(self) -> DataFrame:
        """(replicate, race_no, block, key, value) for base paces, race offsets and race wear rates."""
        fe = F.transform(F.arrays_zip("cars", "fe"), lambda x: F.struct(
            F.lit("fe").alias("block"), F.concat(F.lit("D"), x["cars"].cast("string")).alias("key"), x["fe"].alias("value")))
        rc = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(k).alias("key"), F.col("race_coef")[i].alias("value"))
                       for i, (b, k, _) in enumerate(RACE)])
        return self.local.select("replicate", "race_no", F.explode(F.concat(fe, rc)).alias("x")).select("replicate", "race_no", "x.*")

    def circuit_frame(self, rep: int = 0) -> DataFrame:
        """One row per circuit with its offsets and wear deviations."""
        return self.circuits.filter(F.col("replicate") == rep).select("circuit", "circ_coef")

    def with_circuit(self, laps: DataFrame, rep: int = 0) -> DataFrame:
        """Attach circuit terms."""
        return laps.join(short(self.circuit_frame(rep), self.n_circuits), "circuit", "left")

    def global_column(self, rep: int | None = 0) -> Column:
        """Everything except race-local terms, over lap columns plus ``circ_coef``; unknown circuits add nothing.

        Without ``rep`` the terms are taken from each row's array ``terms``.
        """
        g = {(b, k): F.col("terms")[i] if rep is None else float(self.shared[rep][i]) for i, (b, k, _) in enumerate(GLOBAL)}
        L, age = F.col("l_scale"), F.col("age").cast("double")
        temp = (F.col("track_temp") - 35.0) / 10.0
        circ = lambda i: F.coalesce(F.col("circ_coef")[i], F.lit(0.0))
        h = hinge(F.col("age"))
        per = None
        for ci, c in enumerate(DRY):
            curve = sum((h[j] * g[("deg0" if j == 0 else "deg", f"{c}:{j}")] for j in range(NK)), F.lit(0.0))
            e = (curve + age * temp * g[("temp", c)] + age * circ(2 + ci)
                 + F.when(F.col("lap_in_stint") == 2, g[("cold", c)]).otherwise(0.0))
            if c in OFFSET_COMPOUNDS:
                e = e + g[("off_g", c)] + circ(OFFSET_COMPOUNDS.index(c))
            per = F.when(F.col("compound") == c, e) if per is None else per.when(F.col("compound") == c, e)
        early = (F.when(F.col("lap") == 2, g[("early", "lap2")]).when(F.col("lap") == 3, g[("early", "lap3")]).otherwise(0.0)
                 + F.when(F.col("stint") == 1, g[("early", "stint1")]).otherwise(0.0))
        return L * (F.col("fuel_kg") * g[("fuel", "fuel")] + per.otherwise(0.0) + F.col("gap1") * g[("traffic", "gap1")]
                    + F.col("gap2") * g[("traffic", "gap2")] + early)

    def predict_global(self, laps: DataFrame, out: str = "pred_global", rep: int = 0) -> DataFrame:
        return self.with_circuit(laps, rep).withColumn(out, self.global_column(rep)).drop("circ_coef")

    def predict_replicates(self, laps: DataFrame, out: str = "pred") -> DataFrame:
        """Every row of (replicate, lap columns) by its own replicate, in one pass over ``laps``."""
        terms = self.spark.createDataFrame([(r, [float(v) for v in g]) for r, g in self.shared.items()], "replicate int, terms array<double>")
        df = laps.join(short(terms, len(self.shared)), "replicate").join(short(self.circuits, self.n_circuits), ["replicate", "circuit"], "left").withColumn("_g", self.global_column(None)).drop("circ_coef", "terms")
        local = self.local.drop("n_obs")
        df = df.join(local, ["replicate", "race_no"], "left")
        return df.withColumn(out, F.col("_g") + local_column()).drop("_g", "cars", "fe", "race_coef", "fe_default")

    def predict_local(self, laps: DataFrame, local: DataFrame, on: list[str], out: str = "pred", rep: int = 0) -> DataFrame:
        """Global part plus race-local terms joined on ``on``; a car without a base takes the field's median base."""
        df = self.predict_global(laps, "_g", rep)
        cols = [c for c in local.columns if c not in ("replicate", "n_obs")]
        df = df.join(local.select(*cols), on, "left")
        return df.withColumn(out, F.col("_g") + local_column()).drop("_g", "cars", "fe", "race_coef", "fe_default")


def local_column() -> Column:
    """Race-local contribution from (cars, fe, race_coef, fe_default); null when the race has no local fit."""
    rc = lambda i: F.coalesce(F.col("race_coef")[i], F.lit(0.0))
    age = F.col("age").cast("double")
    per = (F.when(F.col("compound") == "SOFT", rc(0) + age * rc(2)).when(F.col("compound") == "MEDIUM", age * rc(3))
           .when(F.col("compound") == "HARD", rc(1) + age * rc(4)).otherwise(0.0))
    base = F.coalesce(F.element_at(F.map_from_arrays("cars", "fe"), F.col("drv")), F.col("fe_default"))
    return base + F.col("l_scale") * per


def local_fit(model: Model, rep_laps: DataFrame) -> DataFrame:
    """Race-local terms from all of a race's representative laps, shared terms held fixed."""
    stats = race_stats(rep_laps.select(*LAP_COLS).withColumn("replicate", F.lit(0))).withColumn("w", F.lit(1.0))
    circ = short(model.circuits.filter("replicate = 0"), model.n_circuits)
    return stats.join(circ, ["replicate", "circuit"], "left").mapInPandas(_back_substitute({0: model.sigma[0]}, model.shared), LOCAL).drop("replicate")


def _round(stats: DataFrame, weights: DataFrame | None, sigmas: dict[int, float]):
    """One penalised solve from statistics: global terms, circuit table and its rows, race-local table."""
    t = stats.withColumn("w", F.lit(1.0)) if weights is None else stats.join(weights, ["replicate", "race_no"])
    red = stage(sum_arrays(t.mapInPandas(_reduce(sigmas), "replicate int, circuit string, red array<double>"), ["replicate", "circuit"], ["red"]), "reduced")
    shared, circuits = solve_shared(red, sigmas)
    circuits = stage(circuits, "circuit-terms")
    n = circuits.count()
    local = t.join(short(circuits, n), ["replicate", "circuit"], "left").mapInPandas(_back_substitute(sigmas, shared), LOCAL)
    return shared, circuits, n, local


def robust_sigma(resid: DataFrame, weighted: bool) -> dict[int, float]:
    """1.4826 x median absolute deviation from the median, per replicate, frequency-weighted."""
    w = F.col("w").cast("bigint") if weighted else None
    med = group_quantile(resid, ["replicate"], F.col("resid"), 0.5, "med", weight=w).collect()  # one row per replicate
    centre = F.create_map(*[F.lit(x) for r in med for x in (r["replicate"], r["med"])])[F.col("replicate")]
    mad = group_quantile(resid, ["replicate"], F.abs(F.col("resid") - centre), 0.5, "mad", weight=w)
    return {r["replicate"]: 1.4826 * r["mad"] for r in mad.collect()}  # one row per replicate


def fit(rep_laps: DataFrame, sigma: float = FIRST_PASS_SIGMA, passes: int = 2, weights: DataFrame | None = None,
        replicates: int = 0) -> Model:
    """Fit on representative laps. With ``weights`` (replicate, race_no, w) every replicate is fitted at once, in ``refits`` if each race fits a task."""
    spark = rep_laps.sparkSession
    if weights is not None:
        from gridpace.operators import refits
        most, n = rep_laps.groupBy("race_no").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        if (most or 0) <= refits.RACE_LAPS:
            return refits.fit(rep_laps.select(*LAP_COLS), n or 0, weights, sigma, passes, replicates)
    reps = range(1, replicates + 1) if weights is not None else [0]
    sigmas = {r: sigma for r in reps}
    laps = rep_laps.select(*LAP_COLS).withColumn("replicate", F.lit(0))
    model = None
    for p in range(passes):
        stats = stage(race_stats(laps), "race-stats")
        if weights is not None and p == 0:
            stats = stats.drop("replicate").join(weights.select("replicate", "race_no"), "race_no")
        shared, circuits, n, local = _round(stats, weights, sigmas)
        model = Model(spark, shared, circuits, n, stage(local, "race-local"), sigmas)
        if weights is not None and p == 0:
            laps = laps.drop("replicate").join(weights, "race_no")
        scored = model.predict_replicates(laps)
        scored = scored.withColumn("resid", F.col("lap_time") - F.col("pred")).drop("pred")
        scored = stage(scored, "residuals")
        sigmas = robust_sigma(scored, weights is not None)
        model.sigma, model.laps = sigmas, scored
        if p < passes - 1:
            lim = F.create_map(*[F.lit(x) for r, s in sigmas.items() for x in (r, 4.0 * s)])
            laps = scored.filter(F.abs("resid") < lim[F.col("replicate")]).drop("resid")
    model.n_laps = model.laps.count()
    return model


def bootstrap_weights(races: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """How often each race is drawn in each replicate: hash-seeded Poisson(1) counts, reproducible anywhere."""
    u = (F.xxhash64("race_no", "replicate", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))) / float(1 << 52)
    cdf, p, expr = 0.0, np.exp(-1.0), None
    for k in range(12):
        cdf += p
        expr = F.when(u < cdf, k) if expr is None else expr.when(u < cdf, k)
        p /= k + 1
    grid = F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    return (races.select("race_no").distinct().withColumn("replicate", grid)
            .withColumn("w", expr.otherwise(12).cast("double")).filter("w > 0").select("replicate", "race_no", "w"))
