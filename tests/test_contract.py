"""Every registered query has a legal name, the SQL twins exist where SQL can say it, and the flagship query runs."""

import re

import __spark_entry__ as entry


def test_names_and_twins():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert all(re.fullmatch(r"[a-z]_\d\d_[a-z0-9_]+|op\d+_[a-z0-9_]+|pipeline", n) for n in q)
    ids = {n[:4] for n in q}
    want = {"s": 11, "p": 20, "j": 17, "a": 37, "w": 27, "t": 8, "u": 4, "f": 17, "m": 23, "d": 14, "c": 1, "g": 8, "x": 7}
    missing = [f"{k}_{i:02d}" for k, n in want.items() for i in range(1, n + 1) if f"{k}_{i:02d}" not in ids]
    assert missing == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["race_id", "driver", "rep_laps", "laps", "median_lap", "race_ref"]


def test_no_collect_of_laps_in_operators():
    from pathlib import Path
    for p in Path(entry.__file__).parent.joinpath("gridpace").rglob("*.py"):
        text = p.read_text()
        assert "toPandas" not in text and "localCheckpoint" not in text and "crossJoin" not in text, p


def test_rewritten_tables_get_a_new_context(spark, tmp_path):
    from gridpace.registry import Context
    spark.range(3).write.parquet(str(tmp_path / "events.parquet"))
    first = Context.of(spark, str(tmp_path))
    assert Context.of(spark, str(tmp_path)) is first
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "events.parquet"))
    second = Context.of(spark, str(tmp_path))
    assert second is not first and second.table("events").count() == 5


def test_race_ids_keep_every_digit(spark):
    from gridpace.registry import Context
    from gridpace.sources.lapview import lap_view
    c = Context(spark, "unused")
    line = dict(l_linenumber=1, l_partkey=0, l_suppkey=1, l_shipdate="2024-01-01", l_quantity=1.0, l_extendedprice=10.0)
    rows = spark.createDataFrame([dict(line, l_orderkey=250 * 5 * (r - 1)) for r in (1, 999, 1000, 10000)])
    c.table = lambda name: rows
    assert sorted(r[0] for r in lap_view(c).select("race_id").collect()) == ["2021_001", "2021_1000", "2021_10000", "2021_999"]
