"""Corners on the lap's own length against a plain walk round each lap."""

import math

import numpy as np
import pandas as pd
import pytest

from gridpace.operators import telemetry as t

P = t.N_POINTS - 1
METRES = {1: 3000.0, 2: 7000.0, 3: 5000.0, 4: 500.0, 5: 40.0}  # key -> lap length; the last two are shorter than the reach


def half_up(x):
    return math.floor(x + 0.5)


def laps():
    rng = np.random.default_rng(12)
    out = []
    for key, metres in METRES.items():
        a = np.arange(P) * 2 * np.pi / P
        r = 80 + 25 * np.sin(3 * a + key) + 14 * np.sin(8 * a) + 5 * np.sin(17 * a + 1)
        if key == 3:
            r = np.where((a > 2) & (a < 4), 90.0, r)
        v = np.round(200 + 60 * np.sin(7 * a + key) + 25 * np.sin(23 * a) + rng.normal(0, 4, P), 0)
        xy = np.round(np.c_[r * np.cos(a), r * np.sin(a)], 1)
        for i in range(P + 1):
            out.append((key, i, float(xy[i % P, 0]), float(xy[i % P, 1]), float(v[i % P]), metres / t.POSITION_M))
    return pd.DataFrame(out, columns=["key", "i", "x", "y", "speed", "length"])


def plain_corners(v, metres):
    at = lambda i: v[i % P]
    win, reach, brake = (half_up(P * m / metres) for m in (120, 700, 350))
    for i in range(P):
        if any(at(i - k) < v[i] or at(i + k) <= v[i] for k in range(1, max(2, win) + 1)):
            continue
        peak, steps = 0, 0
        for k in range(1, reach + 1):
            if at(i - k) > peak:
                peak, steps = at(i - k), k
            if at(i - k) < v[i]:
                break
        if peak - v[i] >= 20:
            yield i, v[i], peak, min(steps, brake)


def plain_turn(x, y, metres, m):
    for _ in range(2):
        x, y = (np.array([np.mean([c[(i + k) % P] for k in range(-3, 4)]) for i in range(P)]) for c in (x, y))
    x, y = x.round(6), y.round(6)
    h = [math.atan2(y[(i + 1) % P] - y[i - 1], x[(i + 1) % P] - x[i - 1]) for i in range(P)]
    k = max(1, min(P, half_up(P * m / metres)))
    return [math.atan2(math.sin(h[(i + k) % P] - h[i - k]), math.cos(h[(i + k) % P] - h[i - k])) for i in range(P)]


def plain_sweeps(turn, apexes, metres):
    every = max(1, half_up(max(2, min(P, half_up(P * 60 / metres))) / 4))
    taken, out = list(apexes), []
    for i in range(0, P, every):
        if abs(turn[i]) > 0.6 and all(min(abs(i - k), P - abs(i - k)) * metres / P >= 220 for k in taken):
            taken.append(i)
            out.append(i)
    return out


@pytest.fixture(scope="module")
def data(spark):
    pdf = laps()
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_braking_corners_follow_each_laps_metres(data):
    pdf, g = data
    got = t.speed_corners(g).toPandas().sort_values(["key", "apex"])
    seen = {}
    for key, metres in METRES.items():
        v = pdf[pdf.key == key].sort_values("i")["speed"].to_numpy()[:P]
        want = list(plain_corners(v, metres))
        mine = got[got.key == key]
        assert [tuple(r) for r in mine[["apex", "speed", "peak", "entry_steps"]].itertuples(index=False)] == want
        seen[key] = len(want)
    assert seen[1] and seen[2] > seen[1] and seen[5] == 0


def test_sweeps_and_table_follow_each_laps_metres(data):
    pdf, g = data
    braking = t.speed_corners(g)
    turned = t.turns(t.headings(g), {"turn60": 60, "turn70": 70, "turn15": 15})
    tp = turned.toPandas().sort_values(["key", "i"])
    got = t.sweep_corners(turned, braking).toPandas().sort_values(["key", "apex"])
    table = t.corner_table(g).toPandas().sort_values(["key", "n"])
    assert not got.empty
    for key, metres in METRES.items():
        lap = pdf[pdf.key == key].sort_values("i")
        x, y, v = (lap[c].to_numpy()[:P] for c in ("x", "y", "speed"))
        for m in (60, 70, 15):
            diff = tp.loc[tp.key == key, f"turn{m}"].to_numpy() - plain_turn(x, y, metres, m)
            assert np.abs(np.angle(np.exp(1j * diff))).max() < 1e-5
        brake = {c[0]: c for c in plain_corners(v, metres)}
        sweeps = plain_sweeps(plain_turn(x, y, metres, 60), brake, metres)
        assert list(got.loc[got.key == key, "apex"]) == sweeps
        mine = table[table.key == key]
        assert list(mine.apex) == sorted([*brake, *sweeps]) and list(mine.n) == list(range(1, len(mine) + 1))
        turn70, turn15 = plain_turn(x, y, metres, 70), plain_turn(x, y, metres, 15)
        for r in mine.itertuples():
            entry = (r.apex - brake[r.apex][3]) / P if r.kind == "braking" else r.apex / P - 150 / metres
            assert abs(r.entry - entry % 1) < 1e-9 and abs(r.exit - (r.apex / P + 60 / metres) % 1) < 1e-9
            by = turn70 if abs(turn70[r.apex]) > 0.3 else turn15
            assert abs(r.angle - abs(turn70[r.apex])) < 1e-5 and r.dir == (1 if by[r.apex] >= 0 else -1) and r.vmin == v[r.apex]


def test_no_laps(data):
    _, g = data
    assert t.corner_table(g.limit(0)).count() == 0
