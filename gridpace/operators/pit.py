"""Pit stops: controls, measured losses, loss tables, and the neutralisation chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridpace.operators.backtest import race_partitioned
from gridpace.operators.quantile import group_quantile
from gridpace.operators.scan import framed
from gridpace.session import stage

CAR = ["race_no", "drv"]
KEY = ["race_no", "drv", "lap"]
AFTER = 3  # laps past the in-lap at which the gap is read again


def control_rows(ctx) -> DataFrame:
    """Per car and lap a: gap to the leader at a and four laps on, and whether the car stops around it.

    For a stop on lap n, a = n - 1; a control must not be in or out of the pits
    on laps n - 2 .. n + 4.
    """
    f = race_partitioned(ctx, ctx.laps.select(*KEY, "end_us", "pit_in", "pit_out", "blk"))
    lead = Window.partitionBy("race_no", "lap")
    f = f.withColumn("g0", (F.col("end_us") - F.min("end_us").over(lead)) / F.lit(1e6))
    span = 1 + AFTER
    return framed(
        f, CAR, {
            "g1": lambda w: F.when(F.lead("lap", span).over(w) == F.col("lap") + span, F.lead("g0", span).over(w)),
            "busy": lambda w: F.max(F.col("pit_in") | F.col("pit_out")).over(w.rangeBetween(-1, span + 1)),
            "stops_next": lambda w: F.coalesce(F.lead("pit_in").over(w), F.lit(False)),
        }, before=1, after=span + 1, blk=ctx.blk, block_laps=ctx.shape.block_laps)


def stop_controls(ctl: DataFrame) -> DataFrame:
    """Stops joined to the free cars of the same race and lap (at most one row per car on a lap)."""
    s = ctl.filter("stops_next").select("race_no", "lap", "drv", "g0", "g1")
    # laps on which nobody stops are left out before the join
    o = ctl.withColumn("_any", F.max("stops_next").over(Window.partitionBy("race_no", "lap"))).filter("_any").filter("not busy and g0 is not null and g1 is not null").select(
        "race_no", "lap", F.col("drv").alias("other"), F.col("g0").alias("c0"), F.col("g1").alias("c1"))
    return s.join(o, ["race_no", "lap"]).filter("drv <> other").withColumn("lap", F.col("lap") + 1)


def gap_matched_loss(ctl: DataFrame, min_controls: int = 3) -> DataFrame:
    """The stopper's later gap minus the gap a non-stopping car from the same start gap ended with.

    Controls are interpolated linearly at the stopper's gap and held flat at
    the ends. One aggregate finds both brackets, so nothing is collected.
    """
    j = stop_controls(ctl).filter("g0 is not null and g1 is not null")
    # equal start gaps: the last in (c0, c1) order below, the first above, as in an ordered table
    lo = F.max(F.when(F.col("c0") <= F.col("g0"), F.struct("c0", "c1"))).alias("lo")
    hi = F.min(F.when(F.col("c0") > F.col("g0"), F.struct("c0", "c1"))).alias("hi")
    b = j.groupBy(*KEY, "g0", "g1").agg(F.count(F.lit(1)).alias("controls"), lo, hi)
    at = (F.when(F.col("lo").isNull(), F.col("hi.c1")).when(F.col("hi").isNull(), F.col("lo.c1"))
          .otherwise(F.col("lo.c1") + (F.col("hi.c1") - F.col("lo.c1")) * (F.col("g0") - F.col("lo.c0")) / (F.col("hi.c0") - F.col("lo.c0"))))
    return b.filter(F.col("controls") >= min_controls).select(*KEY, "controls", (F.col("g1") - at).alias("loss_gap"))


def measured_stops(ctx, laps: DataFrame, min_controls: int = 3) -> DataFrame:
    """One row per real stop with its measured loss; ``laps`` carries ``expected``, the clean time of each lap.

    A stop is an in-lap whose next recorded lap is an out-lap, in a dry race,
    past lap 1, with both times known and no red flag on either.
    """
    nxt = F.struct("lap", "pit_out", "lap_time", "red", "sc", "vsc", "expected", "compound")
    # laps are numbered without gaps, so an in-lap and the out-lap after it are neighbours among in- and out-laps alone
    df = framed(laps.filter("pit_in or pit_out").select(*KEY, "blk", "year", "circuit", "race_id", "compound", "age", "dry_race", "pit_in", "pit_out", "lap_time",
                            "red", "sc", "vsc", "expected"),
                CAR, {"n": lambda w: F.lead(nxt).over(w)}, after=1, blk=ctx.blk, block_laps=ctx.shape.block_laps)
    ev = df.filter("pit_in and n.lap = lap + 1 and n.pit_out and lap_time is not null and n.lap_time is not null and lap > 1 and dry_race and not red and not n.red")
    regime = F.expr("case when sc and n.sc then 1 when vsc and n.vsc then 2 when not (sc or vsc) and not (n.sc or n.vsc) then 0 else -1 end")
    ev = (ev.withColumn("regime", regime)
          .withColumn("loss_green", F.expr("lap_time + n.lap_time - expected - n.expected")))
    ev = ev.join(gap_matched_loss(control_rows(ctx), min_controls).select(*KEY, "loss_gap"), KEY, "left")
    return ev.select(*KEY, "race_id", "year", "circuit", "compound", F.col("n.compound").alias("next_compound"), "age", "regime",
                     F.when(F.col("regime") == 0, F.col("loss_green")).otherwise(F.col("loss_gap")).alias("loss"), "loss_green", "loss_gap")


def robust(df: DataFrame, keys: list[str], x: str, prefix: str = "") -> DataFrame:
    """Median, 1.4826 x MAD and n after dropping values 8 s or more above the first median."""
    v = df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).alias("x"))
    # each median is one row per group; writing it keeps the next pass from recomputing it
    m1 = stage(group_quantile(v, keys, F.col("x"), 0.5, "m1"), "median")
    kept = _attach(v, m1, keys).filter("x < m1 + 8").drop("m1")
    m2 = stage(group_quantile(kept, keys, F.col("x"), 0.5, "med"), "median")
    dev = _attach(kept, m2, keys).withColumn("d", F.abs(F.col("x") - F.col("med")))
    mad = stage(group_quantile(dev, keys, F.col("d"), 0.5, "mad"), "mad")
    n = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = _attach(_attach(m2, mad, keys), n, keys)
    return out.select(*keys, F.col("med").alias(prefix + "med"), (1.4826 * F.col("mad")).alias(prefix + "mad"), F.col("n").alias(prefix + "n"))


def _attach(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Join one row of statistics per group."""
    if keys:
        return a.join(b, keys)
    return a.withColumn("_k", F.lit(0)).join(F.broadcast(b.withColumn("_k", F.lit(0))), "_k").drop("_k")  # a single row


def pit_loss_table(stops: DataFrame) -> DataFrame:
    """Green loss per circuit (latest season with at least six stops, else all), SC / VSC ratios, and a ``_global`` row."""
    ev = stops.filter("loss_green between 5 and 80")
    green = ev.filter("regime = 0")
    per_year = green.groupBy("circuit", "year").agg(F.count(F.lit(1)).alias("ny"))
    pick = per_year.groupBy("circuit").agg(F.max("year").alias("last"), F.max_by("ny", "year").alias("n_last"), F.sum("ny").alias("n_green"))
    use = green.join(F.broadcast(pick), "circuit").filter("n_last < 6 or year = last")  # one row per circuit
    rows = (use.select(F.col("circuit").alias("grp"), F.col("loss_green").alias("x"))
            .unionByName(green.select(F.lit("_global").alias("grp"), F.col("loss_green").alias("x")))
            .unionByName(green.select(F.lit("_gap").alias("grp"), F.col("loss_gap").alias("x"))))
    rb = stage(robust(rows, ["grp"], "x"), "robust")
    loc = rb.filter("grp not in ('_global', '_gap')").withColumnRenamed("grp", "circuit").join(pick, "circuit")
    glob = rb.filter("grp = '_global'").select(F.col("med").alias("g_med"), F.col("mad").alias("g_mad"))
    gap = rb.filter("grp = '_gap'").select(F.col("med").alias("g_gap"))
    neutral = group_quantile(stops.filter("regime in (1, 2)"), ["regime"], F.col("loss_gap"), 0.5, "m")
    meds = neutral.agg(F.max(F.when(F.col("regime") == 1, F.col("m"))).alias("m_sc"), F.max(F.when(F.col("regime") == 2, F.col("m"))).alias("m_vsc"))
    n_all = green.agg(F.count(F.lit(1)).alias("n_all"))
    one = _attach(_attach(_attach(glob, gap, []), meds, []), n_all, [])
    ratio = lambda m: F.coalesce(F.greatest(F.least(F.col(m) / F.col("g_gap"), F.lit(1.0)), F.lit(0.0)), F.lit(0.5))
    one = one.withColumn("sc_ratio", ratio("m_sc")).withColumn("vsc_ratio", ratio("m_vsc"))
    rows = _attach(loc, one, []).select("circuit", F.col("med").alias("green"), F.when(F.col("n") > 3, F.col("mad")).otherwise(F.col("g_mad")).alias("green_sd"),
                                        "n_green", "sc_ratio", "vsc_ratio")
    return rows.unionByName(one.select(F.lit("_global").alias("circuit"), F.col("g_med").alias("green"), F.col("g_mad").alias("green_sd"),
                                       F.col("n_all").alias("n_green"), "sc_ratio", "vsc_ratio"))
