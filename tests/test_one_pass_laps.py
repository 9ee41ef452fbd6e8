"""Short races go from the lines to the feature table in one shuffle and one write; the lap view is not written on the way."""

import re

import pytest
from pyspark.sql import functions as F

from gridpace.operators.backtest import forecast_rows
from gridpace.operators.features import prepare
from gridpace.operators.pit import control_rows, measured_stops
from gridpace.registry import Context
from gridpace.sources.lapview import LABELS, bare_laps, labelled


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    lines = spark.range(3000).select(
        (n % 700).alias("l_orderkey"), (n * 7 % 200).alias("l_partkey"), (n % 11).alias("l_suppkey"), (n % 5).cast("int").alias("l_linenumber"),
        (n * 13 % 50 + 1).cast("double").alias("l_quantity"), (900 + n * 31 % 977 / 7.0).alias("l_extendedprice"), F.lit("1995-01-01 00:00:00").cast("timestamp").alias("l_shipdate"))
    lines.unionByName(lines.filter(n % 50 == 0)).write.parquet(f"{folder}/lineitem.parquet")
    events = spark.range(400).select(n.alias("event_id"), (n * 37 % 91).cast("double").alias("value"), F.timestamp_seconds(F.lit(1704067200) + n * 400).alias("ts"))
    events.unionByName(events.filter(n % 9 == 0)).write.parquet(f"{folder}/events.parquet")
    return folder


def test_features_equal_those_of_the_staged_view(spark, made):
    one, two = Context(spark, made), Context(spark, made)
    got, want = one.laps, labelled(prepare(two, two.raw_laps.drop(*LABELS)))
    assert "raw_laps" not in vars(one)
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (sorted(map(repr, x.select(*want.columns).collect())) for x in (got, want))
    assert len(got) == 3060 and got == want


def test_lines_and_readings_are_dealt_once(spark, made):
    c = Context(spark, made)
    plan = labelled(prepare(c, bare_laps(c), dealt=True))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(dealt) == 2 and all(x.startswith("race_no") and "wt_us" not in x for x in dealt)


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_gaps_of_short_races_take_one_shuffle(spark, made):
    dealt = exchanges(control_rows(Context(spark, made)))
    assert len(dealt) == 1 and dealt[0].startswith("race_no")


def test_only_laps_in_and_out_of_the_pits_are_read_for_stops(spark, made):
    c = Context(spark, made)
    laps = c.laps.withColumn("expected", F.col("drv_med"))
    got = measured_stops(c, laps)
    assert "Or(EqualTo(pit_in,true),EqualTo(pit_out,true))" in got._jdf.queryExecution().executedPlan().toString()
    at = {(r.race_no, r.drv, r.lap): r for r in laps.collect()}
    want = {}
    for (race, drv, lap), r in at.items():
        n = at.get((race, drv, lap + 1))
        if r.pit_in and n and n.pit_out and lap > 1 and r.dry_race and not r.red and not n.red:
            want[race, drv, lap] = n.compound
    assert want and {(r.race_no, r.drv, r.lap): r.next_compound for r in got.collect()} == want


def test_forecast_pairs_are_shuffled_once(spark, made):
    plan = forecast_rows(Context(spark, made))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")
