"""Bisector tournament and whitening against plain integer and numpy versions; odd rows."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridpace.llm import bisectors, whitening

SCHEMA = "vec_id long, embedding array<double>, x string, cluster int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "old", -1, "n") for i, v in rows], SCHEMA)


def odd_rows(dim):
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, []), (902, [None] + [1.0] * (dim - 1)), (903, [nan] + [1.0] * (dim - 1)), (904, [inf] + [1.0] * (dim - 1))]


def plain_kmeans(rows, k, rounds, seed, dim, scale):
    """Distances in Python integers, one vector after the other."""
    kept = [(i, [int(np.floor(c * scale)) for c in v]) for i, v in rows
            if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    cents = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *near(x)[::-1]) for i, x in kept]
    return out, cents


@pytest.mark.parametrize("k", [1, 2, 7, 12])
def test_tournament_against_plain_distances(spark, k):
    r = np.random.default_rng(k)
    rows = [(i, (r.integers(-3, 4, 5) / 2).tolist()) for i in range(150)]  # coarse: ties and equal centroids
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, [0.25] * 5), (500, [1.0] * 4), (501, [1.0] * 6), *odd_rows(5)]
    placed, c = bisectors.cluster(frame(spark, rows), k=k, rounds=3, dim=5, scale=4)
    want, cents = plain_kmeans(rows, k, 3, bisectors.SEED, 5, 4)
    assert c.tolist() == cents
    order = lambda rows: sorted(rows, key=lambda t: (t[0] is None, t[0] or 0, t[1:]))
    assert order(tuple(x) for x in placed.collect()) == order(want)
    full = bisectors.with_inertia(placed, c).toPandas()
    assert set(full.inertia) == {sum(w[2] for w in want)}
    for j, g in full.groupby("cluster"):
        assert set(g.cluster_inertia) == {sum(w[2] for w in want if w[1] == j)}
        assert set(g.centroid_sha256) == {hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()}


def test_tournament_is_exact_beyond_doubles():
    r = np.random.default_rng(1)
    c = r.integers(-(1 << 27), 1 << 27, (9, 64))
    x = np.vstack([c[3] + 1, (c[2] + c[5]) // 2, r.integers(-(1 << 27), 1 << 27, (50, 64))])
    w = bisectors.Tournament(c).winners(x)
    for row, j in zip(x.tolist(), w.tolist()):
        assert j == min((sum((a - b) ** 2 for a, b in zip(row, q)), i) for i, q in enumerate(c.tolist()))[1]


def test_few_or_no_vectors(spark):
    placed, c = bisectors.cluster(frame(spark, odd_rows(5)), k=3, dim=5)
    assert placed.count() == 0 and bisectors.with_inertia(placed, c).count() == 0
    placed, c = bisectors.cluster(frame(spark, [(1, [1.0] * 5), (2, [2.0] * 5)]), k=3, dim=5)
    assert len(c) == 2 and {r["distance"] for r in placed.collect()} == {0}
    with pytest.raises(ValueError):
        bisectors.cluster(frame(spark, []), k=bisectors.MOST_CENTROIDS + 1)
    with pytest.raises(Exception, match="beyond"):
        bisectors.cluster(frame(spark, [(1, [1e30] * 5)]), dim=5)


def exact_polynomial(m):
    """Faddeev and LeVerrier's recursion in fractions, lowest coefficient first."""
    d = len(m)
    c, a = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        b = [[a[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        a = [[sum(Fraction(m[i][t]) * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(a[i][i] for i in range(d)) / k)
    return [int(x) for x in c[::-1]]


def test_characteristic_polynomial(spark):
    r = np.random.default_rng(2)
    for d, rank, size in ((1, 1, 9), (3, 3, 50), (9, 9, 10**6), (9, 4, 300), (12, 12, 3)):
        z = r.integers(-size, size, (rank, d)).tolist()
        m = [[sum(z[t][i] * z[t][j] for t in range(rank)) for j in range(d)] for i in range(d)]
        assert whitening.characteristic(spark, m) == exact_polynomial(m)


def test_roots_with_multiplicity():
    poly = [1]
    for root in (0, 0, 5, 5, 5, 7, 1000):
        poly = [(-root * a) + b for a, b in zip([*poly, 0], [0, *poly])]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 4, 5, 6, 7, 1000)] == [7, 5, 5, 2, 2, 1, 0]
    got, shift = whitening.largest_roots(poly, 8)
    assert [g / 2 ** shift for g in got] == [1000, 7, 5, 5, 5]
    assert [g / 2 ** shift for g in whitening.largest_roots(poly, 3)[0]] == [1000, 7, 5]
    assert whitening.primes(3) == [2147483647, 2147483629, 2147483587]


@pytest.mark.parametrize("kind", ["plain", "flat", "sphere", "far"])
def test_whitening_against_numpy(spark, kind):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 10)) * np.linspace(0.1, 2, 10)
    if kind == "flat":
        x = x[:, :4] @ r.normal(size=(4, 10)).round(2)
        x[:, 3] = 1.0
        x[:, [5, 6]] = x[:, [0, 0]]
    if kind == "sphere":  # every eigenvalue equal
        x = np.vstack([s * e for e in np.eye(10) for s in (1, -1)])
    if kind == "far":
        x = x + 5000.0
    rows = list(enumerate(x.tolist())) + [(3, x[3].tolist()), (None, x[4].tolist()), *odd_rows(10)[:1], *odd_rows(10)[2:]]
    y = np.floor(1024 * np.vstack([x, x[3], x[4]]))
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert len(got) == len(y) and set(got.n) == {len(y)}
    cov = np.cov(y.T, bias=True)
    value = np.linalg.eigvalsh(cov)[::-1]
    count = int((value > 1e-9 * value[0]).sum())
    z = np.array(got.whitened.tolist())
    assert z.shape[1] == min(8, count)
    assert np.allclose(np.cov(z.T, bias=True), np.eye(z.shape[1]), atol=1e-9) and set(got.identity_error) == {got.identity_error[0]} and got.identity_error[0] < 1e-9
    assert np.allclose(got.explained[0], value[: z.shape[1]] / np.trace(cov), rtol=1e-9)
    big = y.astype(object).astype(int) + 100000
    dev = sorted(((len(y) * big - big.sum(axis=0)) ** 2).sum(axis=1).tolist())
    assert sorted(got.deviation) == dev
    if kind in ("plain", "far"):
        vec = np.linalg.eigh(cov)[1][:, ::-1][:, :8]
        want = ((y - y.mean(axis=0)) @ vec / np.sqrt(value[:8]))[:300]
        mine = np.array(got[got.vec_id < 300].drop_duplicates("vec_id").sort_values("vec_id").whitened.tolist())
        assert np.allclose(np.abs(mine), np.abs(want), atol=1e-7)


def test_whitening_of_little(spark):
    assert whitening.whiten(frame(spark, odd_rows(4)[:1])).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(2, 0, [], 0.0)] * 2
    empty = whitening.whiten(frame(spark, [(1, []), (2, [])])).collect()
    assert [(r["deviation"], r["whitened"]) for r in empty] == [(0, [])] * 2
    short = whitening.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 3.0]), (3, [0.0, 0.0])]))
    assert [len(r["whitened"]) for r in short.collect()] == [2, 2, 2]
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(frame(spark, [(1, [1e30])])).count()


def test_query_rows(spark):
    got = whitening.op13(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    per = got.groupBy("vec_id").agg(F.count("*").alias("n"), F.max("component").alias("c")).distinct().collect()
    assert [tuple(r)[1:] for r in per[:1]] == [(8, 8)] and len(per) == 500
