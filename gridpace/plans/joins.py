"""Join queries (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpace.constants import DRY, TRAIN_YEARS
from gridpace.functions.expr import big, rnd
from gridpace.operators.asof import asof_join
from gridpace.operators.features import WEATHER_BUCKET_US, attach_weather
from gridpace.operators.form import form_table
from gridpace.operators.pit import control_rows, stop_controls
from gridpace.operators.scan import framed
from gridpace.plans.sqltext import feat_sql, laps_sql, weather_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query

CAR = ["race_no", "drv"]
KEY = ["race_no", "drv", "lap"]


@query("j_01_asof_weather_backward", weather_sql("""
select laps.race_no, drv, lap, w.track_temp, w.air_temp from laps asof left join weather w
on laps.race_no = w.race_no and laps.start_us >= w.wt_us"""))
def asof_backward(c):
    return attach_weather(c, c.raw_laps.select(*KEY, "start_us")).select(
        *KEY, F.col("track_temp_raw").alias("track_temp"), F.col("air_temp_raw").alias("air_temp"))


@query("j_02_asof_weather_nearest", weather_sql(f"""
select race_no, count(track_temp) as matched, count(*) as laps, {R('sum(track_temp)', 4)} as temp_sum from n group by race_no""",
"b as (select laps.race_no, drv, lap, start_us, w.wt_us as bt, w.track_temp as bv from laps asof left join weather w on laps.race_no = w.race_no and laps.start_us >= w.wt_us)",
"n as (select b.race_no, drv, lap, case when bt is not null and (w.wt_us is null or start_us - bt <= w.wt_us - start_us) then bv else w.track_temp end as track_temp "
"from b asof left join weather w on b.race_no = w.race_no and b.start_us <= w.wt_us)"))
def asof_nearest(c):
    n = asof_join(c.raw_laps.select(*KEY, "start_us"), c.weather, ["race_no"], "start_us", "wt_us", ["track_temp"], "nearest",
                  bucket=WEATHER_BUCKET_US if c.shape.blocked else None)
    return n.groupBy("race_no").agg(F.count("asof_track_temp").alias("matched"), F.count(F.lit(1)).alias("laps"),
                                    rnd(F.sum("asof_track_temp"), 4).alias("temp_sum"))


@query("j_03_dimension_lookup", f"""
select r_name, o_orderstatus, count(*) as orders, {R('sum(o_totalprice)', 2)} as total from orders left join customer on o_custkey = c_custkey
left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by all""")
def dimension_lookup(c):
    # nation and region are fixed lists of 25 and 5 rows; customer grows, so its join is left to the optimizer
    nr = c.table("nation").join(F.broadcast(c.table("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    cust = c.table("customer").select("c_custkey", "c_nationkey").join(F.broadcast(nr), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    o = c.table("orders").select("o_custkey", "o_orderstatus", "o_totalprice")
    o = o.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    return (o.join(cust, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("r_name", "o_orderstatus")
            .agg(F.sum("n").alias("orders"), rnd(F.sum("t"), 2).alias("total")))


FORM_SQL = """rel as (select race_no, year, round_no, team, quantile_cont(lap_time / race_ref, 0.5) as rel from f where rep group by all),
tf as (select race_no, team, avg(rel) over (partition by team order by year, round_no rows between 4 preceding and 1 preceding) as team_form from rel),
drel as (select race_no, year, round_no, drv, quantile_cont(lap_time / race_ref, 0.5) as rel from f where rep group by all),
dform as (select race_no, drv, avg(rel) over (partition by drv order by year, round_no rows between 4 preceding and 1 preceding) as driver_form from drel),
refs as (select distinct race_no, year, round_no, circuit, race_ref from f),
pref as (select race_no, lag(race_ref) over (partition by circuit order by year, round_no) as prev_ref from refs)"""


@query("j_04_form_merge", feat_sql(f"""
select k.race_no, k.drv, {R('team_form', 6)} as team_form, {R('driver_form', 6)} as driver_form, {R('prev_ref', 5)} as prev_ref
from (select distinct race_no, drv, team from f) k left join tf using (race_no, team) left join dform using (race_no, drv) left join pref using (race_no)""",
FORM_SQL))
def form_merge(c):
    return form_table(c).select("race_no", "drv", rnd("team_form").alias("team_form"), rnd("driver_form").alias("driver_form"),
                                rnd("prev_ref", 5).alias("prev_ref"))


@query("j_05_closest_date", """
with o as (select o_orderkey, o_orderdate, c_nationkey, year(o_orderdate) as y from orders join customer on o_custkey = c_custkey),
sched as (select distinct c_nationkey, y, date_trunc('quarter', o_orderdate) as event_date from o),
m as (select o_orderkey, event_date, abs(date_diff('day', cast(event_date as timestamp), o_orderdate)) as d,
  row_number() over (partition by o_orderkey order by abs(date_diff('day', cast(event_date as timestamp), o_orderdate)), event_date) as rn
  from o left join sched using (c_nationkey, y))
select o_orderkey, d as day_gap, cast(quarter(event_date) as int) as event_quarter from m where rn = 1""")
def closest_date(c):
    """Many candidate dates per (venue, year); each row keeps its nearest, the earlier one on a tie."""
    o = (c.table("orders").join(c.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .select("o_orderkey", "o_orderdate", "c_nationkey", F.year("o_orderdate").alias("y")))
    sched = o.select("c_nationkey", "y", F.date_trunc("quarter", "o_orderdate").cast("date").alias("event_date")).distinct()
    m = o.join(sched, ["c_nationkey", "y"], "left").withColumn("d", F.abs(F.date_diff(F.col("o_orderdate").cast("date"), "event_date")))
    best = m.groupBy("o_orderkey").agg(F.min(F.struct("d", "event_date")).alias("b"))
    return best.select("o_orderkey", big(F.col("b.d")).alias("day_gap"), F.quarter("b.event_date").alias("event_quarter"))


CONTROL_SQL = """cg as (
  select race_no, drv, lap, pit_in, pit_out, cast(end_us - min(end_us) over (partition by race_no, lap) as double) / 1000000 as gap from f),
ctl as (
  select race_no, drv, lap, gap as g0, lead(gap, 4) over c as g1, max(pit_in or pit_out) over (partition by race_no, drv order by lap
    range between 1 preceding and 5 following) as busy, coalesce(lead(pit_in) over c, false) as stops_next from cg window c as (partition by race_no, drv order by lap)),
stopctl as (
  select s.race_no, s.drv, s.lap + 1 as lap, s.g0, s.g1, o.drv as other, o.g0 as c0, o.g1 as c1 from ctl s left join ctl o
  on s.race_no = o.race_no and s.lap = o.lap and s.drv <> o.drv and not o.busy and o.g1 is not null where s.stops_next)"""


@query("j_06_anti_join_controls", feat_sql("""
select race_no, drv, lap, count(other) as controls from stopctl group by all""", CONTROL_SQL))
def controls(c):
    ctl = control_rows(c)
    n = stop_controls(ctl).groupBy(*KEY).agg(F.count("other").alias("controls"))
    stops = ctl.filter("stops_next").select(*CAR, (F.col("lap") + 1).alias("lap"))
    return stops.join(n, KEY, "left").select(*KEY, F.coalesce("controls", F.lit(0)).alias("controls"))


@query("j_07_position_neighbours", feat_sql("""
, line as (select race_no, drv, lap, cast(lag(pit_in) over w as int) as a_pit, cast(lead(pit_in) over w as int) as b_pit, lag(age) over w - age as a_diff, lead(age) over w - age as b_diff
  from f window w as (partition by race_no, lap order by position))
select race_no, drv, lap, coalesce(lag(a_pit) over c, 0) as ahead_stopped_prev, coalesce(lag(b_pit) over c, 0) as behind_stopped_prev,
  coalesce(lag(a_diff) over c, 0) as ahead_age_diff, coalesce(lag(b_diff) over c, 0) as behind_age_diff from line window c as (partition by race_no, drv order by lap)""".strip()))
def neighbours(c):
    """The cars one place ahead and behind on the previous lap; a doubled (lap, position) keeps one car."""
    f = c.laps.select(*KEY, "position", "age", "pit_in")
    prev = framed(f.withColumn("blk", F.expr(f"(lap - 1) div {c.shape.block_laps}")), CAR,
                  {"pos_prev": lambda w: F.lag("position").over(w), "age_prev": lambda w: F.lag("age").over(w)}, before=1,
                  blk=c.blk, block_laps=c.shape.block_laps)
    who = f.groupBy("race_no", "lap", "position").agg(F.max_by(F.struct("age", "pit_in"), "drv").alias("o"))
    out = prev
    for side, off in (("ahead", 1), ("behind", -1)):
        w = who.select("race_no", (F.col("lap") + 1).alias("lap"), (F.col("position") + off).alias("pos_prev"), F.col("o").alias(side))
        out = out.join(w, ["race_no", "lap", "pos_prev"], "left")
    val = lambda s: F.coalesce(F.col(f"{s}.pit_in").cast("int"), F.lit(0)).alias(f"{s}_stopped_prev")
    diff = lambda s: F.coalesce(F.col(f"{s}.age") - F.col("age_prev"), F.lit(0)).alias(f"{s}_age_diff")
    return out.select(*KEY, val("ahead"), val("behind"), diff("ahead"), diff("behind"))


@query("j_08_team_mate_stopped", feat_sql("""
select f.race_no, f.drv, f.lap from f where exists (select 1 from f m where m.race_no = f.race_no and m.team = f.team and m.drv <> f.drv
  and m.lap = f.lap - 1 and m.pit_in)"""))
def mates(c):
    """Laps on which a team-mate stopped the lap before."""
    f = c.laps.select(*KEY, "team", "pit_in")
    stops = f.filter("pit_in").select("race_no", "team", (F.col("lap") + 1).alias("lap"), F.col("drv").alias("mate"))
    a, b = f.select(*KEY, "team").alias("a"), stops.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("race_no", "team", "lap")]
    return a.join(b, [*cond, F.col("a.drv") != F.col("b.mate")], "left_semi").select(*KEY)


@query("j_09_rejoin_position", feat_sql("""
select a.race_no, a.drv, a.lap, count(*) filter (where b.end_us > a.end_us and b.end_us < a.end_us + 22000000) as positions_lost,
  round(coalesce(min(abs(b.end_us - a.end_us - 22000000)) filter (where b.end_us <> a.end_us) / 1000000.0::double, 99.0), 6) as rejoin_gap
from f a join f b on a.race_no = b.race_no and a.lap = b.lap group by all having count(*) > 1"""))
def rejoin(c):
    """Where a car would come back after a 22 s stop: value-range frames over the field's clocks, no self-join."""
    loss = 22_000_000
    w = Window.partitionBy("race_no", "lap").orderBy("end_us")
    t = F.col("end_us") + loss
    inside = F.max("end_us").over(w.rangeBetween(1, loss))
    below = F.max("end_us").over(w.rangeBetween(Window.unboundedPreceding, -1))
    above = F.min("end_us").over(w.rangeBetween(loss, Window.unboundedFollowing))
    return (c.laps.select(*KEY, "end_us", F.count(F.lit(1)).over(Window.partitionBy("race_no", "lap")).alias("n"),
                          F.count(F.lit(1)).over(w.rangeBetween(1, loss - 1)).alias("positions_lost"),
                          F.least(t - F.coalesce(inside, below), above - t).alias("g"))
            .filter("n > 1")
            .select(*KEY, "positions_lost", F.round(F.coalesce(F.col("g") / F.lit(1e6), F.lit(99.0)), 6).alias("rejoin_gap")))


@query("j_10_asof_fan_out", feat_sql(f"""
select race_no, k, count(*) as obs, {R('sum(lap_time)', 3)} as total, count(distinct drv) as cars from f,
  (select unnest(generate_series(5, (select max(race_laps) from f), 5)) as k) where rep and lap <= k and k < race_laps - 1 group by all"""))
def fan_out(c):
    """Every representative lap joins the observation sets of all later checkpoints k = 5, 10, ..., by exploding its own list."""
    ks = F.expr("case when race_laps - 2 >= greatest(5, (lap + 4) div 5 * 5) then sequence(greatest(5, (lap + 4) div 5 * 5), race_laps - 2, 5L) end")
    per_car = (c.laps.filter("rep").select("race_no", "drv", "lap_time", F.explode(ks).alias("k"))
               .groupBy("race_no", "k", "drv").agg(F.count(F.lit(1)).alias("n"), F.sum("lap_time").alias("t")))
    return per_car.groupBy("race_no", "k").agg(F.sum("n").alias("obs"), rnd(F.sum("t"), 3).alias("total"), F.count(F.lit(1)).alias("cars"))


@query("j_14_fallback_to_global", feat_sql(f"""
, m as (select circuit, avg(lap_time - race_ref) as v, count(*) as n from f where pit_out and green and dry_race group by circuit),
lim as (select quantile_cont(n, 0.5) as q from m),
g as (select avg(lap_time - race_ref) as gv from f where pit_out and green and dry_race)
select cc.circuit, {R('coalesce(m.v, g.gv)', 4)} as loss, m.v is null as used_global from (select distinct circuit from f) cc
left join m on m.circuit = cc.circuit and m.n >= (select q from lim) cross join g""".strip()))
def fallback(c):
    """Circuits with too few measured out-laps take the ``_global`` row."""
    f = c.laps.filter("pit_out and green and dry_race").select("circuit", (F.col("lap_time") - F.col("race_ref")).alias("x"))
    m = f.groupBy("circuit").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    glob = m.agg((F.sum("s") / F.sum("n")).alias("gv"), F.percentile("n", F.lit(0.5)).alias("q")).withColumn("one", F.lit(1))
    known = c.laps.select("circuit").distinct().withColumn("one", F.lit(1))
    j = known.join(m, "circuit", "left").join(F.broadcast(glob), "one")  # one row
    local = F.when(F.col("n") >= F.col("q"), F.col("s") / F.col("n"))
    return j.select("circuit", rnd(F.coalesce(local, "gv"), 4).alias("loss"), local.isNull().alias("used_global"))


@query("j_15_newest_dry_race", feat_sql("""
select circuit, arg_max(race_id, row(year, round_no)) as race_id from f where dry_race group by circuit"""))
def newest_dry(c):
    return c.laps.filter("dry_race").groupBy("circuit").agg(F.max_by("race_id", F.struct("year", "round_no")).alias("race_id"))


@query("j_16_parameter_grid", feat_sql("""
select g1.deg_sd, g2.sc, g3.margin, year, count(*) filter (where gap_behind > g3.margin and (not f.sc or gap_ahead * g2.sc < 10)) as laps
from f, (values (0.0::double), (0.01), (0.005), (0.0025)) g1(deg_sd), (values (0.1::double), (0.3), (0.5), (0.7)) g2(sc),
(values (0.0::double), (0.5), (1.0), (2.0), (3.0), (4.0)) g3(margin) where pit_in group by all"""))
def grid(c):
    """Every stop is scored under the 4 x 4 x 6 parameter grid: the grid is a literal array, exploded per row."""
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    f = c.laps.filter("pit_in").select("year", "gap_behind", "gap_ahead", "sc")
    g = (f.withColumn("deg_sd", F.explode(arr([0, 0.01, 0.005, 0.0025]))).withColumn("scr", F.explode(arr([0.1, 0.3, 0.5, 0.7])))
         .withColumn("margin", F.explode(arr([0, 0.5, 1, 2, 3, 4]))))
    return g.groupBy("deg_sd", F.col("scr").alias("sc"), "margin", "year").agg(
        F.count_if((F.col("gap_behind") > F.col("margin")) & (~F.col("sc") | (F.col("gap_ahead") * F.col("scr") < 10))).alias("laps"))


@query("j_17_column_alignment", feat_sql("""
, tr as (select distinct compound from f where year in (2021, 2022, 2023))
select f.year, f.compound, count(*) as laps, max(case when tr.compound is null then 0 else 1 end) as known from f left join tr using (compound)
group by f.year, f.compound""".strip()))
def alignment(c):
    """One-hot columns follow the training seasons; a category unseen there gets an all-zero row."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    f = c.laps.select("year", "compound")
    tr = f.filter(F.col("year").isin(*TRAIN_YEARS))
    idx = StringIndexer(inputCol="compound", outputCol="i", handleInvalid="keep", stringOrderType="alphabetAsc").fit(tr)
    agg = idx.transform(f.groupBy("year", "compound").agg(F.count(F.lit(1)).alias("laps")))
    enc = OneHotEncoder(inputCol="i", outputCol="v", dropLast=True).fit(idx.transform(tr.select("compound").distinct()))
    from pyspark.ml.functions import vector_to_array
    hot = F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, x: a + x).cast("int")
    return enc.transform(agg).select("year", "compound", "laps", hot.alias("known"))
