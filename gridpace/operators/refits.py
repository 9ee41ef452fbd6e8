"""Bootstrap refits of the ridge model: every replicate at once, without a row per lap and replicate.

A race is one row: its laps, and the replicates that drew it. What a replicate keeps of a race, its local terms and
residuals follow in the task from the laps, the shared terms and those of the circuit, so a step reads the laps once
whatever the number of replicates; only reduced systems, counts of residuals by leading bits and the residuals of the wanted bin leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpace.constants import DRY
from gridpace.operators import ridge
from gridpace.operators.gram import FLUSH_KEYS, sum_arrays
from gridpace.operators.quantile import _pick
from gridpace.operators.ridge import CIRC, GLOBAL, NG, NR, NS, P, RACE, RACE_IX, SHARED_IX, W1
from gridpace.session import stage

RACE_LAPS = 1 << 17  # laps of a race that a task holds at once: 38 MB of base columns
HELD = 1 << 21  # residuals whose counts are held before they are added up
LEADING = 44  # bits of a double that do not choose its bin: 8 of the mantissa do
COLS = [c for c in ridge.LAP_COLS if c not in ("race_no", "circuit")]


def packed(laps: DataFrame, weights: DataFrame, n_laps: int) -> DataFrame:
    """One row per race that any replicate drew."""
    rows = laps.groupBy("race_no", "circuit").agg(F.collect_list(F.struct(*COLS)).alias("laps"))
    drawn = weights.filter("w > 0").groupBy("race_no").agg(F.sort_array(F.collect_list(F.struct("replicate", "w"))).alias("drawn"))
    tasks = max(2 * laps.sparkSession.sparkContext.defaultParallelism, -(-n_laps // RACE_LAPS))
    return stage(rows.join(drawn, "race_no").repartition(tasks, "race_no"), "refit-races")


def with_terms(races: DataFrame, circuits: DataFrame, n: int, out: str) -> DataFrame:
    """Races with their circuit's terms in every replicate."""
    per = circuits.groupBy("circuit").agg(F.collect_list(F.struct("replicate", "circ_coef")).alias(out))  # one entry per replicate
    return races.join(ridge.short(per, n), "circuit", "left")


def _kept_stats(Z: np.ndarray, car: np.ndarray, D: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cross-products and per-car sums of each different set of kept laps, and the set of each replicate."""
    sets: dict[bytes, int] = {}
    bits = np.packbits(keep, axis=0)
    of = np.array([sets.setdefault(bits[:, j].tobytes(), len(sets)) for j in range(keep.shape[1])])
    G, S = np.empty((len(sets), P + 1, P + 1)), np.empty((len(sets), D, W1))
    ones = np.column_stack([np.ones(len(Z)), Z])
    hot = (car[:, None] == np.arange(D)).astype(float)
    whole = Z.T @ Z, hot.T @ ones
    finite = np.isfinite(whole[0]).all()
    for u in range(len(sets)):
        m = keep[:, int(np.argmax(of == u))]
        few = finite and 2 * m.sum() > len(m)  # what is left out is less than what is kept
        z, h, o = (x[~m] if few else x[m] for x in (Z, hot, ones))
        G[u], S[u] = z.T @ z, h.T @ o
        if few:
            G[u], S[u] = whole[0] - G[u], whole[1] - S[u]
            S[u, S[u, :, 0] == 0] = 0.0  # counts are exact
    return G, S, of


def _systems(G, S, of, w, sigma):
    """``ridge._race_system`` of every replicate."""
    k, D = len(of), S.shape[1]
    each = {s: ridge._penalties(s) for s in set(sigma)}
    lam = [each[s] for s in sigma]
    lam_r, lam_fe = np.array([x[1] for x in lam]), np.array([x[2] for x in lam])
    w3, G, S = w[:, None, None], G[of], S[of]
    n, sx, sy = S[..., 0], S[..., 1:1 + P], S[..., -1]
    ll, d, r = np.zeros((k, D + NR, D + NR)), np.arange(D), np.arange(D, D + NR)
    ll[:, d, d] = w[:, None] * n + lam_fe[:, None]
    ll[:, :D, D:] = w3 * sx[:, :, RACE_IX]
    ll[:, D:, :D] = ll[:, :D, D:].swapaxes(1, 2)
    ll[:, D:, D:] = w3 * G[:, RACE_IX][:, :, RACE_IX]
    ll[:, r, r] += lam_r
    ls = w3 * np.concatenate([sx[:, :, SHARED_IX], G[:, RACE_IX][:, :, SHARED_IX]], axis=1)
    ss = w3 * G[:, SHARED_IX][:, :, SHARED_IX]
    bl = w[:, None] * np.concatenate([sy, G[:, RACE_IX, P]], axis=1)
    return ll, ls, ss, bl, w[:, None] * G[:, SHARED_IX, P], n > 0


def _local(system, shared, circ):
    """Base of each car (that of a car without laps is the median of the others), race terms, and that median, by replicate."""
    ll, ls, _, bl, _, seen = system
    b = np.linalg.solve(ll, (bl - (ls @ np.concatenate([shared, circ], axis=1)[..., None])[..., 0])[..., None])[..., 0]
    D = seen.shape[1]
    middle = np.array([np.median(x[s]) if s.any() else np.nan for x, s in zip(b[:, :D], seen)])
    return np.where(seen, b[:, :D], middle[:, None]), b[:, D:], middle


def _residuals(Z, car, shared, circ, fe, race) -> np.ndarray:
    """Laps x replicates."""
    B = np.zeros((len(shared), P))
    for terms, values in ((GLOBAL, shared), (CIRC, circ), (RACE, race)):
        for j, (*_, i) in enumerate(terms):
            B[:, i] += values[:, j]
    return Z[:, -1:] - (Z[:, :-1] @ B.T + fe[:, car].T)


class Races:
    """The races of an Arrow batch, each with its laps, replicates and what these keep after the earlier ``steps``.

    A step is (sigmas of the fit, shared terms, largest residual kept), by replicate; circuit terms of step q are in the column ``circ{q}``.
    """

    def __init__(self, steps: list):
        self.steps = steps

    def of(self, batch: pa.RecordBatch):
        lists, drawn = batch.column("laps"), batch.column("drawn").to_pylist()
        flat = lists.flatten()
        cols = dict(zip([x.name for x in flat.type], flat.flatten()))
        comp = np.array([*DRY, None], object)[pc.fill_null(pc.index_in(cols["compound"], pa.array(DRY)), len(DRY)).to_numpy()]
        cols = {c: comp if c == "compound" else x.to_numpy(zero_copy_only=False) for c, x in cols.items()}
        ends = np.cumsum(lists.value_lengths().to_numpy())
        terms = [batch.column(f"circ{q}").to_pylist() if f"circ{q}" in batch.schema.names else None for q in range(len(self.steps))]
        for i, (race, circuit) in enumerate(zip(batch.column("race_no").to_pylist(), batch.column("circuit").to_pylist())):
            at = slice(ends[i] - len(lists[i]), ends[i])
            pdf = pd.DataFrame({c: x[at] for c, x in cols.items()})
            cars, car = np.unique(pdf["drv"].to_numpy(), return_inverse=True)
            yield Race(race, circuit, cars.astype(np.int64), car, np.column_stack([ridge.base_matrix(pdf), pdf["lap_time"].to_numpy(float)]), drawn[i], [t and t[i] for t in terms], self.steps)


class Race:
    def __init__(self, race, circuit, cars, car, Z, drawn, terms, steps):
        self.race, self.circuit, self.cars, self.car, self.Z, self.terms, self.steps = race, circuit, cars, car, Z, terms, steps
        self.reps, self.w = np.array([x["replicate"] for x in drawn]), np.array([x["w"] for x in drawn])
        self.keep = np.ones((len(Z), len(self.reps)), bool)
        for q, (_, _, limit) in enumerate(steps[:-1]):
            self.keep &= np.abs(self.residuals(q)) < np.array([limit[r] for r in self.reps])

    def system(self, q: int):
        sigma = self.steps[q][0]
        return _systems(*_kept_stats(self.Z, self.car, len(self.cars), self.keep), self.w, [sigma[r] for r in self.reps])

    def local(self, q: int):
        by = {x["replicate"]: x["circ_coef"] for x in self.terms[q] or ()}
        shared = np.array([self.steps[q][1][r] for r in self.reps])
        circ = np.array([by.get(r, np.zeros(NS - NG)) for r in self.reps], float)
        return shared, circ, *_local(self.system(q), shared, circ)

    def residuals(self, q: int) -> np.ndarray:
        shared, circ, fe, race, _ = self.local(q)
        return _residuals(self.Z, self.car, shared, circ, fe, race)


def _frame(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], pa.schema(list(zip(names, types))))


def _reduced(steps):
    names, types = ["replicate", "circuit", "red"], [pa.int32(), pa.string(), pa.list_(pa.float64())]

    def run(batches):
        acc: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for x in Races(steps).of(batch):
                ll, ls, ss, bl, bs, _ = x.system(len(steps) - 1)
                sol = np.linalg.solve(ll, np.concatenate([ls, bl[..., None]], axis=2))
                back = ls.swapaxes(1, 2) @ sol
                back[..., :-1] = ss - back[..., :-1]
                back[..., -1] = bs - back[..., -1]
                for r, red, some in zip(x.reps, back, x.keep.any(axis=0)):
                    if some:
                        k = (int(r), x.circuit)
                        acc[k] = acc[k] + red if k in acc else red.copy()
                if len(acc) > FLUSH_KEYS:
                    yield _frame([(*k, v.ravel()) for k, v in acc.items()], names, types)
                    acc.clear()
        if acc:
            yield _frame([(*k, v.ravel()) for k, v in acc.items()], names, types)
    return run


def _local_rows(steps):
    names, floats = ["replicate", "race_no", "cars", "fe", "race_coef", "fe_default"], pa.list_(pa.float64())

    def run(batches):
        for batch in batches:
            for x in Races(steps).of(batch):
                system = x.system(len(steps) - 1)
                _, _, fe, race, middle = x.local(len(steps) - 1)
                rows = [(int(r), x.race, x.cars[s], fe[j][s], race[j], middle[j]) for j, (r, s) in enumerate(zip(x.reps, system[-1])) if s.any()]
                yield _frame(rows, names, [pa.int32(), pa.int64(), pa.list_(pa.int64()), floats, floats, pa.float64()])
    return run


def _values(steps, centre):
    """(replicate, residuals kept or their distances from ``centre``, weight), and how many laps are kept."""
    def of(batch):
        for x in Races(steps).of(batch):
            resid = x.residuals(len(steps) - 1)
            for j, r in enumerate(x.reps):
                v = resid[x.keep[:, j], j]
                n, v = len(v), v[~np.isnan(v)]
                yield int(r), (v if centre is None else np.abs(v - centre[r])) + 0.0, int(x.w[j]), n
    return of


def _bins(v: np.ndarray) -> np.ndarray:
    """The leading bits of doubles, as integers in their order."""
    b = np.ascontiguousarray(v).view(np.int64)
    return (b ^ ((b >> 63) & np.int64((1 << 63) - 1))) >> LEADING


def _counted(steps, centre):
    values = _values(steps, centre)
    half = 1 << (63 - LEADING)

    def run(batches):
        codes, n, laps, held = [], [], {}, 0

        def flush():
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            rows = pa.RecordBatch.from_arrays([pa.array(code // (2 * half), pa.int32()), pa.array(code % (2 * half) - half, pa.int64()),
                                               pa.array(np.bincount(at, np.concatenate(n)).astype(np.int64)), pa.array(np.zeros(len(code), np.int64))], ["replicate", "bin", "n", "laps"])
            codes.clear(), n.clear()
            return rows
        for batch in batches:
            for r, v, w, kept in values(batch):
                codes.append(_bins(v) + half + r * 2 * half)
                n.append(np.full(len(v), w))
                laps[r] = laps.get(r, 0) + kept
                held += len(v)
                if held > HELD:
                    held = 0
                    yield flush()
        if codes:
            yield flush()
        for r, k in laps.items():
            yield _frame([(r, None, 0, k)], ["replicate", "bin", "n", "laps"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()])
    return run


def _near(steps, centre, bins):
    values = _values(steps, centre)

    def run(batches):
        for batch in batches:
            rows, below = [], {}
            for r, v, w, _ in values(batch):
                if r in bins:
                    b = _bins(v)
                    below[r] = below.get(r, 0) + w * int((b < bins[r][0]).sum())
                    v = v[(b >= bins[r][0]) & (b <= bins[r][1])]
                    rows.append((np.full(len(v), r), v, np.full(len(v), w)))
            rows += [(np.array([r]), np.array([np.nan]), np.array([n])) for r, n in below.items()]
            if rows:
                r, v, n = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(v, from_pandas=True), pa.array(n, pa.int64())], ["replicate", "_x", "_n"])
    return run


def _median(races: DataFrame, steps, centre=None) -> tuple[dict[int, float], int]:
    """The weighted median of each replicate's residuals, or of their distances from ``centre``; and the laps that all replicates keep."""
    c = stage(races.mapInArrow(_counted(steps, centre), "replicate int, bin bigint, n bigint, laps bigint").groupBy("replicate", "bin").agg(F.sum("n").alias("n"), F.sum("laps").alias("laps")), "residual-bins")
    w = Window.partitionBy("replicate").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # bins, not laps
    per = c.filter("bin is not null").withColumn("to", F.sum("n").over(w))
    cnt = c.groupBy("replicate").agg(F.sum("n").alias("_cnt")).filter("_cnt > 0")
    per = per.join(cnt, "replicate").withColumn("p", 0.5 * (F.col("_cnt") - 1))
    covers = lambda pos: (F.col("to") - F.col("n") <= pos) & (F.col("to") > pos)
    want = per.groupBy("replicate").agg(*[F.max(F.when(covers(f("p")), F.col("bin"))).alias(x) for f, x in ((F.floor, "b0"), (F.ceil, "b1"))])
    bins = {r["replicate"]: (r["b0"], r["b1"]) for r in want.collect()}  # one row per replicate
    near = races.mapInArrow(_near(steps, centre, bins), "replicate int, _x double, _n bigint").groupBy("replicate", "_x").agg(F.sum("_n").alias("_n")).filter("_n > 0")
    got = _pick(near, cnt, ["replicate"], 0.5, "m").collect()  # one row per replicate
    return {r["replicate"]: r["m"] for r in got}, c.agg(F.sum("laps")).first()[0] or 0


def fit(laps: DataFrame, n_laps: int, weights: DataFrame, sigma: float, passes: int, replicates: int) -> ridge.Model:
    """``ridge.fit`` with weights, for races that each fit a task."""
    sigmas = {r: sigma for r in range(1, replicates + 1)}
    races, steps, model = packed(laps, weights, n_laps), [], None
    for p in range(passes):
        steps.append((sigmas, None, None))
        red = stage(sum_arrays(races.mapInArrow(_reduced(list(steps)), "replicate int, circuit string, red array<double>"), ["replicate", "circuit"], ["red"]), "reduced")
        shared, circuits = ridge.solve_shared(red, sigmas)
        circuits = stage(circuits, "circuit-terms")
        n = circuits.count()
        races = with_terms(races, circuits, n, f"circ{p}")
        steps[p] = (sigmas, shared, None)
        fitted = list(steps)
        med, _ = _median(races, fitted)
        mad, n_kept = _median(races, fitted, med)
        if p == passes - 1:
            local = stage(races.mapInArrow(_local_rows(fitted), ridge.LOCAL), "race-local")
            model = ridge.Model(laps.sparkSession, shared, circuits, n, local, {}, n_kept)
        sigmas = {r: 1.4826 * v for r, v in mad.items()}
        steps[p] = (*steps[p][:2], {r: 4.0 * s for r, s in sigmas.items()})
    model.sigma = sigmas
    return model
