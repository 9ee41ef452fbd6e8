"""Telemetry series: cleaning, arc length, resampling, corners.

A series is ordered by the unique pair ``o`` of microsecond and event id. Neighbours and running sums use
the scans of ``scan``; when one series is huge they work per time bucket.
After resampling every series has exactly ``N_POINTS`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridpace.constants import BLOCK_LAPS
from gridpace.operators.scan import running

N_POINTS = 360
POSITION_M = 6.0          # metres of one step of the derived positions
REACH = 1_000_000         # distance in frame order that stands for a lap's own number of steps
BUCKET_US = 600_000_000   # ten minutes of samples per bucket when a series is huge


def samples(ctx) -> tuple[DataFrame, str | None]:
    """Telemetry of each key: position (x, y), speed, DRS flag and time; plus the bucket column, or None when all series are short."""
    us = F.expr("timestampdiff(microsecond, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    k = F.get_json_object("props", "$.k").cast("double")
    ev = ctx.table("events")
    df = ev.select(F.col("user_id").alias("key"), F.struct(us.alias("us"), F.col("event_id").alias("e")).alias("o"), (us / F.lit(1e6)).alias("t"),
                   F.floor(F.col("value") / 4).cast("double").alias("x"), F.floor(k / 20).cast("double").alias("y"),
                   (F.col("value") % 23 * 10 + k).alias("speed"), (F.col("event_type") == "click").cast("double").alias("drs"),
                   F.expr(f"timestampdiff(microsecond, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div {BUCKET_US}").alias("bucket"))
    longest = ctx.memo("series_rows", lambda: ev.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0)
    limit = ctx._block_laps or 50 * BLOCK_LAPS
    return df, ("bucket" if longest > limit else None)


def moved(df: DataFrame, blk: str | None) -> DataFrame:
    """Drop samples that repeat the point before them."""
    df = running(df, ["key"], {"_p": ("last", F.struct("x", "y"))}, order="o", blk=blk)
    return df.filter(F.col("_p").isNull() | (F.col("_p.x") != F.col("x")) | (F.col("_p.y") != F.col("y")))


def arc_length(df: DataFrame, blk: str | None) -> DataFrame:
    """Distance along the line: running sum of straight steps."""
    step = F.when(F.col("_p").isNotNull(), F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y"))).otherwise(F.lit(0.0))
    df = df.withColumn("_step", step)
    df = running(df, ["key"], {"_s": ("sum", F.col("_step"))}, order="o", blk=blk)
    return df.withColumn("s", F.coalesce("_s", F.lit(0.0)) + F.col("_step")).drop("_s", "_step", "_p")


def resample(df: DataFrame, at: str, channels: list[str], n: int = N_POINTS, blk: str | None = None) -> DataFrame:
    """``n`` evenly spaced rows per key along ``at`` (increasing), every channel interpolated linearly.

    Each sample generates the grid positions between itself and the next, so
    no join and no per-key collection is needed.
    """
    df = df.withColumn("_neg", F.struct(-F.col("o.us"), -F.col("o.e"))).withColumn("_nb", -F.col(blk) if blk else F.lit(0))
    pack = F.struct(at, *channels)
    df = running(df, ["key"], {"_n": ("last", pack)}, order="_neg", blk="_nb" if blk else None)
    ends = df.groupBy("key").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    df = df.join(ends, "key").filter("_hi > _lo")
    pos = lambda c: (c - F.col("_lo")) * (n - 1) / (F.col("_hi") - F.col("_lo"))
    first = F.ceil(pos(F.col(at)))
    last = F.when(F.col(f"_n.{at}") < F.col("_hi"), F.ceil(pos(F.col(f"_n.{at}"))) - 1).otherwise(F.lit(n - 1).cast("bigint"))
    g = df.filter(F.col("_n").isNotNull() & (F.col(f"_n.{at}") > F.col(at))).withColumn("i", F.explode(F.when(last >= first, F.sequence(first, last))))
    here = F.col("_lo") + F.col("i") * (F.col("_hi") - F.col("_lo")) / (n - 1)
    u = (here - F.col(at)) / (F.col(f"_n.{at}") - F.col(at))
    return g.select("key", "i", *[(F.col(c) + (F.col(f"_n.{c}") - F.col(c)) * u).alias(c) for c in channels], (F.col("_hi") - F.col("_lo")).alias("length"))


def grid(ctx) -> DataFrame:
    """The resampled lap of each key: N_POINTS rows of position, speed, DRS and time."""
    def make():
        from gridpace.session import stage
        df, blk = samples(ctx)
        return stage(resample(arc_length(moved(df, blk), blk), "s", ["x", "y", "speed", "drs", "t"], blk=blk), "telemetry-grid")
    return ctx.memo("telemetry_grid", make)


def even_speed(ctx) -> DataFrame:
    """The grid with speeds to six digits, so that equal speeds compare as equal."""
    return grid(ctx).withColumn("speed", F.round("speed", 6))


def length_m() -> Column:
    """The lap's own length in metres."""
    return F.round("length", 6) * POSITION_M


def steps(m: float, n: int = N_POINTS) -> Column:
    """Grid steps in ``m`` metres of the row's own lap, rounded half up; at most once round."""
    return F.least(F.floor(F.lit((n - 1) * m) / length_m() + 0.5), F.lit(n - 1).cast("bigint"))


def padded(g: DataFrame, before: int | Column, after: int | Column, period: int) -> DataFrame:
    """A closed lap: rows near the ends are repeated one period away so windows can run around the loop."""
    shift = F.array(F.lit(0), F.when(F.col("i") >= F.lit(period) - before, F.lit(-period)), F.when(F.col("i") < after, F.lit(period)))
    return g.filter(F.col("i") < period).withColumn("_d", F.explode(F.filter(shift, lambda x: x.isNotNull()))).withColumn("j", F.col("i") + F.col("_d"))


def within(k: Column) -> WindowSpec:
    """Window over a lap in which the rows up to ``k`` steps away, and no others, lie within REACH; ``k`` is one per lap."""
    return Window.partitionBy("key").orderBy(F.floor(F.col("j") * REACH / (k + 0.5)))


def speed_corners(g: DataFrame, n: int = N_POINTS, drop: float = 20.0) -> DataFrame:
    """Speed minima within 120 m that lie ``drop`` below the peak of the braking run before them (up to 700 m).

    Metres are those of the lap's own ``length``, so frames differ from lap to lap.
    """
    p = g.select("key", "i", "speed", "length", F.greatest(F.lit(2), steps(120, n)).alias("win"), steps(700, n).alias("reach"), steps(350, n).alias("brake"))
    p = padded(p, F.greatest("win", "reach"), F.col("win"), n - 1)
    near = within(F.col("win"))
    back = F.reverse(F.collect_list("speed").over(within(F.col("reach")).rangeBetween(-REACH, -1)))  # less than a lap
    p = p.select("key", "i", "j", "speed", "length", "brake", F.min("speed").over(near.rangeBetween(-REACH, -1)).alias("lo_back"),
                 F.min("speed").over(near.rangeBetween(1, REACH)).alias("lo_ahead"), back.alias("back"))
    p = p.filter((F.col("i") == F.col("j")) & (F.col("lo_back") >= F.col("speed")) & (F.col("lo_ahead") > F.col("speed")))
    cut = F.array_position(F.transform("back", lambda v: v < F.col("speed")), True)
    run = F.when(cut > 0, F.slice("back", F.lit(1), cut)).otherwise(F.col("back"))
    p = p.withColumn("peak", F.array_max(run)).withColumn("peak_at", F.array_position(run, F.array_max(run)))
    return p.filter(F.col("peak") - F.col("speed") >= drop).select("key", F.col("i").alias("apex"), "speed", "peak",
                                                                  F.least("peak_at", "brake").alias("entry_steps"), "length")


def smooth(g: DataFrame, cols: list[str], half: int = 3, passes: int = 2, n: int = N_POINTS, keep: list[str] = ()) -> DataFrame:
    """Circular moving average over 2 * half + 1 points, repeated."""
    out = g
    for _ in range(passes):
        p = padded(out.select("key", "i", *cols, *keep), half, half, n - 1)
        w = Window.partitionBy("key").orderBy("j").rowsBetween(-half, half)
        out = p.select("key", "i", "j", *[F.avg(c).over(w).alias(c) for c in cols], *keep).filter("i = j").drop("j")
    return out


def angle_between(a: Column, b: Column) -> Column:
    """Turn from heading ``a`` to ``b`` in (-pi, pi]; nine digits of sine and cosine, so that a full reversal is pi."""
    return F.atan2(F.round(F.sin(b - a), 9), F.round(F.cos(b - a), 9))


def headings(g: DataFrame, n: int = N_POINTS) -> DataFrame:
    """Direction ``h`` of the smoothed line at every point of the loop."""
    s = smooth(g, ["x", "y"], n=n, keep=["length"]).withColumns({c: F.round(c, 6) for c in ("x", "y")})
    w = Window.partitionBy("key").orderBy("j")
    p = padded(s, 1, 1, n - 1).withColumn("h", F.atan2(F.lead("y").over(w) - F.lag("y").over(w), F.lead("x").over(w) - F.lag("x").over(w)))
    return p.filter("i = j").select("key", "i", "h", "length")


def turns(h: DataFrame, over: dict[str, float], n: int = N_POINTS) -> DataFrame:
    """For each name the turn from so many metres behind a point to as many ahead, the metres being the lap's own."""
    span = {name: F.greatest(F.lit(1), steps(m, n)) for name, m in over.items()}
    p = padded(h, F.greatest(*span.values(), F.lit(1)), F.greatest(*span.values(), F.lit(1)), n - 1)
    cols = []
    for name, k in span.items():
        w = Window.partitionBy("key").orderBy(F.floor(F.col("j") * REACH / k))
        there = lambda at: F.first("h").over(w.rangeBetween(at - 1, at + 1))  # one row: the next is REACH / (n - 1) away
        cols.append(angle_between(there(-REACH), there(REACH)).alias(name))
    return p.select("key", "i", "j", "length", *cols).filter("i = j").drop("j")


def sweep_corners(turned: DataFrame, braking: DataFrame, n: int = N_POINTS, min_turn: float = 0.6) -> DataFrame:
    """Direction changes (``turn60``) with no braking corner and no sweep picked before them within 220 m, in lap order.

    A lap has at most ``n - 1`` candidates. They come in rising order, so the nearest sweep taken is the last one or,
    round the end of the lap, the first.
    """
    period = n - 1
    every = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(2), steps(60, n)) / 4 + 0.5))
    gap = F.lit(220.0 * period) / length_m()
    cand = turned.filter((F.col("i") % every == 0) & (F.round(F.abs(F.col("turn60")), 6) > min_turn))
    cand = cand.groupBy("key", "length").agg(F.sort_array(F.collect_list(F.struct("i", F.col("turn60").alias("turn")))).alias("cand"))
    known = braking.groupBy(F.col("key").alias("_k")).agg(F.collect_list("apex").alias("known"))
    d = cand.join(known, F.col("key") == F.col("_k"), "left").withColumn("gap", gap)
    off = lambda a, b: F.least(F.abs(a - b), F.lit(period) - F.abs(a - b))
    d = d.withColumn("cand", F.when(F.col("known").isNull(), F.col("cand")).otherwise(
        F.filter("cand", lambda x: F.forall("known", lambda k: off(k, x["i"]) >= F.col("gap")))))
    first, last = lambda a: F.element_at(a, 1)["i"], lambda a: F.element_at(a, -1)["i"]
    free = lambda a, x: (F.size(a) == 0) | ((x["i"] - last(a) >= F.col("gap")) & (F.lit(period) - (x["i"] - first(a)) >= F.col("gap")))
    d = d.withColumn("got", F.aggregate("cand", F.expr("filter(cand, x -> false)"), lambda a, x: F.when(free(a, x), F.concat(a, F.array(x))).otherwise(a)))
    return d.select("key", "length", F.explode("got").alias("g")).select("key", F.col("g.i").alias("apex"), F.col("g.turn").alias("turn"), "length")


def corner_table(g: DataFrame, n: int = N_POINTS) -> DataFrame:
    """Braking corners and flat-out sweeps numbered round the lap.

    ``entry`` and ``exit`` are fractions of the lap: the start of braking (a sweep: 150 m before it) and 60 m after the
    apex. ``angle`` is the size of the turn within 70 m; ``dir`` its sign where it is over 0.3, else that within 15 m.
    """
    period = n - 1
    turned = turns(headings(g, n), {"turn60": 60, "turn70": 70, "turn15": 15}, n)
    braking = speed_corners(g, n)
    sweeps = sweep_corners(turned, braking, n)
    at = F.col("apex") / period
    a = braking.select("key", "apex", F.lit("braking").alias("kind"), F.col("speed").alias("vmin"), ((F.col("apex") - F.col("entry_steps")) / period).alias("entry"))
    b = sweeps.join(g.select("key", F.col("i").alias("apex"), "speed"), ["key", "apex"]).select(
        "key", "apex", F.lit("sweep").alias("kind"), F.col("speed").alias("vmin"), (at - F.lit(150.0) / length_m()).alias("entry"))
    c = a.unionByName(b).join(turned.withColumnRenamed("i", "apex"), ["key", "apex"])
    wrap = lambda x: x - F.floor(x)
    side = lambda x: F.when(F.round(x, 9) >= 0, 1).otherwise(-1)
    return c.select("key", F.row_number().over(Window.partitionBy("key").orderBy("apex")).cast("bigint").alias("n"), "apex", "kind", "vmin", wrap(F.col("entry")).alias("entry"),
                    wrap(at + F.lit(60.0) / length_m()).alias("exit"), F.abs("turn70").alias("angle"),
                    F.when(F.round(F.abs("turn70"), 6) > 0.3, side(F.col("turn70"))).otherwise(side(F.col("turn15"))).alias("dir"))
