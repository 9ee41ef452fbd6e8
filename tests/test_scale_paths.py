"""The paths used for huge groups give exactly what the plain paths give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpace.operators.asof import asof_join
from gridpace.operators.quantile import group_quantile
from gridpace.plans import load_all
from gridpace.registry import QUERIES, Context

load_all()
SF = "/root/testdata/sf0.001"

BLOCKED = ["p_08_temperature_fill", "p_10_representative_laps", "j_01_asof_weather_backward", "j_02_asof_weather_nearest", "j_06_anti_join_controls",
           "j_07_position_neighbours", "w_01_stint_fill", "w_03_stops_before", "w_04_two_compounds", "w_06_previous_lap_context", "w_07_real_stop_or_retirement",
           "w_11_pace_drop", "w_12_last_and_mean_of_five", "w_15_lagged_field_stops", "w_16_near_stops", "w_18_run_starts", "w_20_stint_segments",
           "w_21_cumulative_clock", "w_23_green_pace_interpolated", "a_04_pit_events", "a_20_regression_metrics", "a_35_forecast_mae_per_driver", "t_06_every_nth_sample",
           "g_01_drop_repeated_points", "g_02_arc_length", "m_22_decision_features", "c_01_clean_pace"]


@pytest.fixture(scope="module")
def blocked(spark):
    return Context(spark, SF, block_laps=7)


def table(df):
    p = df.toPandas()
    p = p[sorted(p.columns)]
    return p.sort_values(list(p.columns), ignore_index=True)


@pytest.mark.parametrize("name", BLOCKED)
def test_blocked_equals_plain(ctx, blocked, name):
    assert blocked.shape.blocked and not ctx.shape.blocked
    a, b = table(QUERIES[name](ctx)), table(QUERIES[name](blocked))
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_sketch_bracketed_quantile_is_exact(spark, q):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 40_000, p=[0.9, 0.0995, 0.0005]), "v": np.round(rng.normal(size=40_000), 3)})
    got = group_quantile(spark.createDataFrame(pdf), ["k"], F.col("v"), q, "x").toPandas().set_index("k")["x"]
    for k, g in pdf.groupby("k"):
        assert abs(got[k] - np.quantile(g["v"], q)) < 1e-12
    whole = group_quantile(spark.createDataFrame(pdf), [], F.col("v"), q, "x").first()["x"]
    assert abs(whole - np.quantile(pdf["v"], q)) < 1e-12


def test_weighted_quantile_equals_repeated_rows(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 3000), "v": rng.exponential(size=3000), "w": rng.integers(0, 4, 3000)})
    got = group_quantile(spark.createDataFrame(pdf), ["k"], F.col("v"), 0.5, "x", weight=F.col("w")).toPandas().set_index("k")["x"]
    for k, g in pdf.groupby("k"):
        assert abs(got[k] - np.median(np.repeat(g["v"], g["w"]))) < 1e-12


def test_outliers_and_ties_leave_few_values_to_rank(spark):
    from gridpace.operators import quantile
    rng = np.random.default_rng(8)
    v = np.where(rng.random(40_000) < 0.9, 7.25, rng.normal(90, 3, 40_000))
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 40_000), "v": np.concatenate([v[:39_990], [1e12, -1e12, 0.0, -0.0, 1e-310, -1e-310, 1.7e308, 8.0, -8.0, np.nextafter(8, 0)]]), "w": rng.integers(1, 4, 40_000)})
    df = spark.createDataFrame(pdf)
    for q in (0.0, 0.02, 0.5, 0.95, 1.0):
        got = group_quantile(df, ["k"], F.col("v"), q, "x", weight=F.col("w")).toPandas().set_index("k")["x"]
        for k, g in pdf.groupby("k"):
            want = np.quantile(np.repeat(g["v"], g["w"]), q)
            assert abs(got[k] - want) <= 1e-12 * max(1.0, abs(want))
    vc = df.groupBy("v").agg(F.sum("w").alias("_n")).withColumnRenamed("v", "_v")
    near = quantile._narrowed(vc, vc.agg(F.sum("_n").alias("_cnt")), [], 0.97, 4096)
    assert near.count() < 20 < vc.count() / 100
    x = spark.range(-3000, 3001).select((F.col("id") / 7 * F.pow(F.lit(2.0), F.col("id") % 40)).alias("x"))
    b = x.select("x", quantile._leading_bits(F.col("x")).alias("b")).orderBy("x").toPandas()
    assert (np.diff(b.b) >= 0).all() and b.b.nunique() > 1500


def test_asof_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"g": rng.integers(0, 2, 200), "t": rng.integers(0, 1000, 200), "id": range(200)})
    right = pd.DataFrame({"g": rng.integers(0, 2, 30), "r": rng.choice(1000, 30, replace=False), "v": rng.random(30)})
    l, r = spark.createDataFrame(left), spark.createDataFrame(right)
    for bucket in (None, 90):
        for way in ("backward", "nearest"):
            got = asof_join(l, r, ["g"], "t", "r", ["v"], way, bucket=bucket).toPandas().set_index("id")["asof_v"]
            for x in left.itertuples():
                c = right[right.g == x.g]
                if way == "backward":
                    c = c[c.r <= x.t]
                    want = c.loc[c.r.idxmax(), "v"] if len(c) else None
                else:
                    d = (c.r - x.t).abs()
                    near = c[d == d.min()]
                    want = near.loc[near.r.idxmin(), "v"]
                assert (want is None and pd.isna(got[x.id])) or abs(got[x.id] - want) < 1e-12
