"""Telemetry queries (G) and circular-window queries (W-25 .. W-27)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpace.functions.expr import rnd
from gridpace.operators import telemetry as t
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query

SAMPLES_SQL = """sm as (
  select user_id as key, struct_pack(us := epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00'), e := event_id) as o,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 1000000.0::double as t, floor(value / 4)::double as x,
    floor(cast(json_extract_string(props, '$.k') as double) / 20)::double as y, value % 23 * 10 + cast(json_extract_string(props, '$.k') as double) as speed,
    case when event_type = 'click' then 1.0::double else 0.0 end as drs from events),
mv as (select * from (select *, lag(x) over w as px, lag(y) over w as py from sm window w as (partition by key order by o)) where px is null or px <> x or py <> y),
st as (select *, case when px is null then 0.0::double else sqrt((x - px) * (x - px) + (y - py) * (y - py)) end as step from mv),
al as (select key, o, t, x, y, speed, drs, sum(step) over (partition by key order by o rows unbounded preceding) as s from st),
nx as (select al.*, lead(s) over w as ns, lead(x) over w as nx, lead(y) over w as ny, lead(speed) over w as nspeed, lead(drs) over w as ndrs, lead(t) over w as nt,
  min(s) over (partition by key) as lo, max(s) over (partition by key) as hi from al window w as (partition by key order by o)),
gg as (select *, unnest(generate_series(cast(ceil((s - lo) * 359 / (hi - lo)) as bigint),
  case when ns < hi then cast(ceil((ns - lo) * 359 / (hi - lo)) as bigint) - 1 else 359 end)) as i from nx where hi > lo and ns > s),
gu as (select *, (lo + i * (hi - lo) / 359 - s) / (ns - s) as u from gg),
grid as materialized (select key, i, x + (nx - x) * u as x, y + (ny - y) * u as y, speed + (nspeed - speed) * u as speed, drs + (ndrs - drs) * u as drs, t + (nt - t) * u as t, hi - lo as length from gu)"""


def tel_sql(body: str, *ctes: str) -> str:
    return "with " + ",\n".join([SAMPLES_SQL, *ctes]) + "\n" + body


def n():
    return F.count(F.lit(1))


@query("g_01_drop_repeated_points", tel_sql("select key, count(*) as points, cast(sum(x) as bigint) as sx, cast(sum(y) as bigint) as sy from mv group by key"))
def repeated(c):
    df, blk = t.samples(c)
    return t.moved(df, blk).groupBy("key").agg(n().alias("points"), F.sum("x").cast("bigint").alias("sx"), F.sum("y").cast("bigint").alias("sy"))


@query("g_02_arc_length", tel_sql(f"select key, o.us as us, o.e as event_id, {R('s', 5)} as s from al"))
def arc(c):
    df, blk = t.samples(c)
    return t.arc_length(t.moved(df, blk), blk).select("key", F.col("o.us").alias("us"), F.col("o.e").alias("event_id"), rnd("s", 5).alias("s"))


@query("g_03_resample", tel_sql(f"select key, i, {R('x', 5)} as x, {R('y', 5)} as y, {R('speed', 4)} as speed from grid"))
def resampled(c):
    return t.grid(c).select("key", "i", rnd("x", 5).alias("x"), rnd("y", 5).alias("y"), rnd("speed", 4).alias("speed"))


@query("g_04_principal_axis", tel_sql(f"select key, {R('0.5 * atan2(2 * covar_samp(x, y), var_samp(x) - var_samp(y))', 5)} as angle from mv group by key having count(*) > 2"))
def axis(c):
    """Angle of the long axis, modulo pi, from the 2 x 2 covariance."""
    df, blk = t.samples(c)
    g = t.moved(df, blk).groupBy("key").agg(n().alias("n"), F.covar_samp("x", "y").alias("cxy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"))
    return g.filter("n > 2").select("key", rnd(0.5 * F.atan2(2 * F.col("cxy"), F.col("vx") - F.col("vy")), 5).alias("angle"))


@query("g_05_unit_box", tel_sql(f"""
, b as (select key, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(speed) as z0 from grid group by key)
select key, i, {R('(x - x0) / greatest(x1 - x0, y1 - y0)', 4)} as nx, {R('(y - y0) / greatest(x1 - x0, y1 - y0)', 4)} as ny, {R('(y1 - y0) / (x1 - x0)', 5)} as aspect,
  {R('(speed - z0) / greatest(x1 - x0, y1 - y0)', 4)} as z from grid join b using (key) where x1 > x0""".strip()))
def box(c):
    b = t.grid(c).groupBy("key").agg(*[f(v).alias(v + k) for v in ("x", "y") for f, k in ((F.min, "0"), (F.max, "1"))], F.min("speed").alias("z0")).filter("x1 > x0")
    s = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return t.grid(c).join(b, "key").select("key", "i", rnd((F.col("x") - F.col("x0")) / s, 4).alias("nx"), rnd((F.col("y") - F.col("y0")) / s, 4).alias("ny"),
                                           rnd((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")), 5).alias("aspect"), rnd((F.col("speed") - F.col("z0")) / s, 4).alias("z"))


@query("g_06_drs_zone_share", tel_sql(f"""
, k as (select key, key % 12 as circuit, row_number() over (partition by key % 12 order by key) - 1 as r, count(*) over (partition by key % 12) as n from (select distinct key from grid)),
p as (select circuit, key from k where r % greatest(1, n // 60) = 0)
select circuit, i, count(*) as laps, {R('avg(drs)')} as share, round(avg(drs), 9) >= 0.2 as open from p join grid using (key) group by all""".strip()))
def drs(c):
    """Share of about sixty sampled laps per circuit with DRS open, per distance bin, and whether it is a zone."""
    g = t.grid(c).withColumn("circuit", F.col("key") % 12)
    keys = g.select("circuit", "key").distinct()
    # ordinal of a lap inside its circuit: counted per bucket of keys first, so no window spans a circuit
    keys = keys.withColumn("kb", F.expr("key div 4096"))
    per = keys.groupBy("circuit", "kb").agg(n().alias("m"))
    cw = Window.partitionBy("circuit")
    per = per.withColumn("off", F.coalesce(F.sum("m").over(cw.orderBy("kb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("m").over(cw))
    r = keys.withColumn("r", F.row_number().over(Window.partitionBy("circuit", "kb").orderBy("key")) - 1).join(per, ["circuit", "kb"])
    pick = r.filter((F.col("r") + F.col("off")) % F.greatest(F.lit(1), F.floor(F.col("n") / 60)) == 0).select("circuit", "key")
    a = g.join(pick, ["circuit", "key"]).groupBy("circuit", "i").agg(n().alias("laps"), F.avg("drs").alias("s"))
    return a.select("circuit", "i", "laps", rnd("s").alias("share"), (F.round("s", 9) >= 0.2).alias("open"))


@query("g_07_time_to_distance", tel_sql(f"""
, tf as (select key, i, (t - min(t) over (partition by key)) / (max(t) over (partition by key) - min(t) over (partition by key)) as f from grid),
tp as (select *, lag(f) over (partition by key order by i) as f0 from tf),
q as (select j, j / 10.0::double as x from (select unnest(generate_series(1, 9)) as j))
select key, j, {R('least(0.99999, (i - 1 + case when f > f0 then (x - f0) / (f - f0) else 0 end) / 359)', 5)} as dist from tp join q on f0 < x and x <= f""".strip()))
def time_to_distance(c):
    """Distance fraction at 10 %, 20 %, ... of the lap time: each grid step answers for the fractions inside it."""
    g = t.grid(c)
    e = g.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    g = g.join(e, "key").withColumn("f", (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    g = g.withColumn("f0", F.lag("f").over(Window.partitionBy("key").orderBy("i")))  # N_POINTS rows per key
    tenths = F.filter(F.array(*[F.struct(F.lit(j).cast("bigint").alias("j"), F.lit(j / 10).alias("x")) for j in range(1, 10)]),
                      lambda q: (q["x"] > F.col("f0")) & (q["x"] <= F.col("f")))
    g = g.withColumn("q", F.explode(tenths))
    u = F.when(F.col("f") > F.col("f0"), (F.col("q.x") - F.col("f0")) / (F.col("f") - F.col("f0"))).otherwise(F.lit(0.0))
    return g.select("key", "q.j", rnd(F.least(F.lit(0.99999), (F.col("i") - 1 + u) / (t.N_POINTS - 1)), 5).alias("dist"))


CORNER_SQL = f"""lp as (select *, round(length, 6) * {t.POSITION_M}::double as m from grid),
rg as (select key, i, round(speed, 6) as speed, m, greatest(2, least(cast(floor(359.0::double * 120 / m + 0.5) as bigint), 359)) as win,
  least(cast(floor(359.0::double * 700 / m + 0.5) as bigint), 359) as reach, least(cast(floor(359.0::double * 350 / m + 0.5) as bigint), 359) as brake from lp where i < 359),
pd as (select *, i as j from rg union all select *, i - 359 from rg where i >= 359 - greatest(win, reach) union all select *, i + 359 from rg where i < win),
pw as (select *, min(speed) over (w rows between win preceding and 1 preceding) as lob, min(speed) over (w rows between 1 following and win following) as loa,
  list_reverse(list(speed) over (w rows between reach preceding and 1 preceding)) as back from pd window w as (partition by key order by j)),
pm as (select *, list_position(list_transform(back, lambda v: v < speed), true) as cut from pw where i = j and lob >= speed and loa > speed),
pr as (select *, case when coalesce(cut, 0) > 0 then list_slice(back, 1, cut) else back end as run from pm),
corners as (select key, i as apex, speed, m, list_max(run) as peak, least(list_position(run, list_max(run)), brake) as entry_steps from pr where list_max(run) - speed >= 20)"""


@query("w_25_speed_minima_corners", tel_sql(f"select key, apex, {R('speed', 4)} as vmin, {R('peak', 4)} as peak, cast(entry_steps as bigint) as entry_steps from corners", CORNER_SQL))
def corners(c):
    return t.speed_corners(t.even_speed(c)).select("key", "apex", rnd("speed", 4).alias("vmin"), rnd("peak", 4).alias("peak"), "entry_steps")


SMOOTH_SQL = """p1 as (select key, i, x, y, i + d as j from grid, (values (0), (-359), (359)) v(d) where i < 359 and (d = 0 or (d < 0 and i >= 356) or (d > 0 and i < 3))),
s1 as (select key, i, j, avg(x) over w as x, avg(y) over w as y from p1 window w as (partition by key order by j rows between 3 preceding and 3 following)),
p2 as (select key, i, x, y, i + d as j from (select * from s1 where i = j) s, (values (0), (-359), (359)) v(d) where d = 0 or (d < 0 and i >= 356) or (d > 0 and i < 3)),
s2 as (select key, i, j, avg(x) over w as x, avg(y) over w as y from p2 window w as (partition by key order by j rows between 3 preceding and 3 following))"""


def turn_sql(name: str, m: int) -> str:
    """Turn between the points ``m`` metres behind and ahead, looked up by their number round the loop."""
    k = f"greatest(1, least(cast(floor(359.0::double * {m} / c.m + 0.5) as bigint), 359))"
    return f"""{name} as (select c.key, c.i, c.m, atan2(round(sin(b.h - a.h), 9) + 0.0, round(cos(b.h - a.h), 9) + 0.0) as turn from hd c
  join hd a on a.key = c.key and a.i = (c.i - {k} + 359) % 359 join hd b on b.key = c.key and b.i = (c.i + {k}) % 359)"""


SWEEP_SQL = ",\n".join([SMOOTH_SQL, """sr as (select key, i, round(x, 6) as x, round(y, 6) as y from s2 where i = j),
hd as (select c.key, c.i, rg.m, atan2(b.y - a.y, b.x - a.x) as h from sr c join sr a on a.key = c.key and a.i = (c.i + 358) % 359
  join sr b on b.key = c.key and b.i = (c.i + 1) % 359 join rg on rg.key = c.key and rg.i = c.i)""", turn_sql("t60", 60), """
cd as (select key, i, turn, 359 * 220.0::double / m as gap from t60
  where i % greatest(1, cast(floor(greatest(2, least(floor(359.0::double * 60 / m + 0.5), 359)) / 4.0::double + 0.5) as bigint)) = 0 and round(abs(turn), 6) > 0.6),
cf as (select * from cd where not exists (select 1 from corners k where k.key = cd.key and least(abs(k.apex - cd.i), 359 - abs(k.apex - cd.i)) < cd.gap)),
pk as (select key, min(i) as first, min(i) as last from cf group by key
  union all
  select pk.key, pk.first, min(cf.i) from pk join cf on cf.key = pk.key and cf.i - pk.last >= cf.gap and 359 - (cf.i - pk.first) >= cf.gap group by pk.key, pk.first, pk.last),
sweeps as (select cf.key, cf.i as apex, turn from cf join pk on pk.key = cf.key and pk.last = cf.i)"""])


def loop_sql(body: str, *ctes: str) -> str:
    return tel_sql(body, CORNER_SQL, SWEEP_SQL, *ctes).replace("with ", "with recursive ", 1)


@query("w_26_direction_change_corners", loop_sql(f"select key, apex, {R('turn', 4)} as turn from sweeps"))
def sweeps(c):
    g = t.even_speed(c)
    return t.sweep_corners(t.turns(t.headings(g), {"turn60": 60}), t.speed_corners(g)).select("key", "apex", rnd("turn", 4).alias("turn"))


@query("w_27_circular_average", tel_sql(f"select key, i, {R('x', 5)} as x, {R('y', 5)} as y from s2 where i = j", SMOOTH_SQL))
def circular(c):
    return t.smooth(t.grid(c), ["x", "y"]).select("key", "i", rnd("x", 5).alias("x"), rnd("y", 5).alias("y"))


@query("g_08_corner_table", loop_sql(f"""select key, row_number() over (partition by key order by apex) as n, apex, kind, {R('vmin', 4)} as vmin,
  {R('entry - floor(entry)', 5)} as entry, {R('apex / 359.0::double + 60.0::double / m - floor(apex / 359.0::double + 60.0::double / m)', 5)} as exit, {R('abs(t70.turn)', 4)} as angle,
  case when round(abs(t70.turn), 6) > 0.3 then case when round(t70.turn, 9) >= 0 then 1 else -1 end when round(t15.turn, 9) >= 0 then 1 else -1 end as dir
from cn join t70 using (key, apex) join t15 using (key, apex)""",
    turn_sql("u70", 70), turn_sql("u15", 15), "t70 as (select key, i as apex, m, turn from u70), t15 as (select key, i as apex, turn from u15)",
    """cn as (select key, apex, 'braking' as kind, speed as vmin, (apex - entry_steps) / 359.0::double as entry from corners
  union all select rg.key, apex, 'sweep', rg.speed, apex / 359.0::double - 150.0::double / m from sweeps join rg on rg.key = sweeps.key and rg.i = apex)"""))
def corner_table(c):
    """Braking-zone corners and flat-out sweeps numbered round the lap."""
    return t.corner_table(t.even_speed(c)).select("key", "n", "apex", "kind", rnd("vmin", 4).alias("vmin"), rnd("entry", 5).alias("entry"),
                                                      rnd("exit", 5).alias("exit"), rnd("angle", 4).alias("angle"), "dir")
