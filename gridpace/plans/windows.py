"""Window-function queries (W-01 .. W-24)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridpace.functions.expr import big, lerp, rnd, status_bucket
from gridpace.operators.field import field_pace, green_pace
from gridpace.operators.form import previous_visit, rolling_form
from gridpace.operators.ordering import placed
from gridpace.operators.scan import framed, running
from gridpace.plans.joins import FORM_SQL
from gridpace.plans.sqltext import feat_sql, laps_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.registry import query

CAR = ["race_no", "drv"]
KEY = ["race_no", "drv", "lap"]


def car_frames(c, df, cols, before=0, after=0):
    return framed(df, CAR, cols, before=before, after=after, blk=c.blk, block_laps=c.shape.block_laps)


def rep_rows(c, *extra):
    """Representative laps in order of their own ordinal, with the block column of that ordinal."""
    return (c.laps.filter("rep").select(*KEY, "rep_no", *extra)
            .withColumn("blk", F.expr(f"(rep_no - 1) div {c.shape.block_laps}")))


@query("w_01_stint_fill", laps_sql("""
select race_no, drv, lap, cast(coalesce(last_value(case when cents % 7 = 0 then null else stint end ignore nulls)
  over (partition by race_no, drv order by lap rows unbounded preceding), 1) as bigint) as stint from laps"""))
def stint_fill(c):
    """Every seventh stint number is missing and takes the car's latest known one."""
    df = c.raw_laps.select(*KEY, "blk", F.when(F.col("cents") % 7 != 0, F.col("stint")).alias("s"))
    df = running(df, CAR, {"prev": ("last", F.col("s"))}, blk=c.blk)
    return df.select(*KEY, F.coalesce("s", "prev", F.lit(1)).cast("bigint").alias("stint"))


@query("w_02_lap_in_stint", laps_sql("""
select race_no, drv, lap, row_number() over (partition by race_no, drv, stint order by lap) as lap_in_stint from laps"""))
def lap_in_stint(c):
    """Stints are contiguous, so the row number is the distance from the stint's first lap."""
    first = c.raw_laps.groupBy(*CAR, "stint").agg(F.min("lap").alias("first"))
    return c.raw_laps.join(first, [*CAR, "stint"]).select(*KEY, (F.col("lap") - F.col("first") + 1).alias("lap_in_stint"))


@query("w_03_stops_before", laps_sql("""
select race_no, drv, lap, cast(coalesce(sum(cast(pit_in as int)) over (partition by race_no, drv order by lap
  rows between unbounded preceding and 1 preceding), 0) as bigint) as stops_before from laps"""))
def stops_before(c):
    df = running(c.raw_laps.select(*KEY, "blk", "pit_in"), CAR, {"n": ("sum", F.col("pit_in").cast("bigint"))}, blk=c.blk)
    return df.select(*KEY, F.coalesce("n", F.lit(0)).cast("bigint").alias("stops_before"))


@query("w_04_two_compounds", feat_sql("select race_no, drv, lap, two_compounds from f"))
def two_compounds(c):
    return c.laps.select(*KEY, "two_compounds")


@query("w_05_gap_ahead", feat_sql(f"select race_no, drv, lap, {R('gap_ahead')} as gap_ahead, {R('gap_behind')} as gap_behind from f"))
def gaps(c):
    w = Window.partitionBy("race_no", "lap").orderBy(F.col("end_us").asc_nulls_last(), "drv")
    gap = lambda x: F.coalesce(x / F.lit(1e6), F.lit(99.0))
    return c.raw_laps.select(*KEY, rnd(gap(F.col("end_us") - F.lag("end_us").over(w))).alias("gap_ahead"),
                             rnd(gap(F.lead("end_us").over(w) - F.col("end_us"))).alias("gap_behind"))


@query("w_06_previous_lap_context", feat_sql(f"""
select race_no, drv, lap, lag(position) over c as position_prev, {R('lag(t_end) over c')} as t_prev, lag(age) over c as age_prev,
  {R('coalesce(lag(gap_ahead) over c, 99.0)')} as gap_ahead_prev, {R('coalesce(lag(gap_behind) over c, 99.0)')} as gap_behind_prev,
  lag(stops_before) over c as stops_before_prev from f window c as (partition by race_no, drv order by lap)"""))
def previous_lap(c):
    cols = ["position", "t_end", "age", "gap_ahead", "gap_behind", "stops_before"]
    df = car_frames(c, c.laps.select(*KEY, "blk", *cols), {f"{x}_prev": (lambda w, x=x: F.lag(x).over(w)) for x in cols}, before=1)
    return df.select(*KEY, "position_prev", rnd("t_end_prev").alias("t_prev"), "age_prev",
                     rnd(F.coalesce("gap_ahead_prev", F.lit(99.0))).alias("gap_ahead_prev"),
                     rnd(F.coalesce("gap_behind_prev", F.lit(99.0))).alias("gap_behind_prev"), "stops_before_prev")


@query("w_07_real_stop_or_retirement", feat_sql("""
, x as (select race_no, drv, lap, pit_in, coalesce(lead(pit_out) over (partition by race_no, drv order by lap), false) as next_out from f)
select race_no, drv, lap, next_out as real_stop, not next_out as retired from x where pit_in""".strip()))
def real_stop(c):
    df = car_frames(c, c.laps.select(*KEY, "blk", "pit_in", "pit_out"), {"next_out": lambda w: F.coalesce(F.lead("pit_out").over(w), F.lit(False))}, after=1)
    return df.filter("pit_in").select(*KEY, F.col("next_out").alias("real_stop"), (~F.col("next_out")).alias("retired"))


@query("w_08_rolling_form", feat_sql(f"select race_no, drv, {R('driver_form')} as driver_form from dform", FORM_SQL))
def form(c):
    return rolling_form(c, "drv", "driver_form").select("race_no", "drv", rnd("driver_form").alias("driver_form"))


@query("w_09_previous_visit", feat_sql(f"select race_no, {R('prev_ref', 5)} as prev_ref from pref", FORM_SQL))
def visit(c):
    return previous_visit(c).select("race_no", rnd("prev_ref", 5).alias("prev_ref"))


@query("w_10_race_index", laps_sql("""
select race_no, dense_rank() over (order by year, round_no) as race_index from (select distinct race_no, year, round_no from laps)"""))
def race_index(c):
    """Chronological index: a race's place in the order of all, counted by ranges."""
    races = c.raw_laps.groupBy("year", "round_no").agg(F.max("race_no").alias("race_no"))
    return placed(races, [], ["year", "round_no"]).select("race_no", F.col("pos").cast("bigint").alias("race_index"))


@query("w_11_pace_drop", feat_sql(f"""
select race_no, drv, lap, {R('''avg(case when rep then lap_time end) over (partition by race_no, drv, stint order by lap rows between 3 preceding and 1 preceding)
 - min(case when rep then lap_time end) over (partition by race_no, drv, stint order by lap rows between unbounded preceding and 1 preceding)''')} as pace_drop from f"""))
def pace_drop(c):
    """Mean of the last three laps minus the stint's best so far, representative laps only, current lap excluded."""
    df = c.laps.select(*KEY, "blk", "stint", F.when(F.col("rep"), F.col("lap_time")).alias("lt"))
    stint = [*CAR, "stint"]
    df = framed(df, stint, {"last3": lambda w: F.avg("lt").over(w.rowsBetween(-3, -1))}, before=3, blk=c.blk, block_laps=c.shape.block_laps)
    df = running(df, stint, {"best": ("min", F.col("lt"))}, blk=c.blk)
    return df.select(*KEY, rnd(F.col("last3") - F.col("best")).alias("pace_drop"))


@query("w_12_last_and_mean_of_five", feat_sql(f"""
, k as (select f.*, k, row_number() over (partition by race_no, drv, k order by lap desc) as rn from f, (select unnest(generate_series(5, (select max(race_laps) from f), 5)) as k)
  where rep and lap <= k and k < race_laps - 1)
select race_no, drv, k, {R('max(case when rn = 1 then lap_time end)')} as last_lap, {R('avg(case when rn <= 5 then lap_time end)')} as mean_last5
from k group by all""".strip()))
def last_five(c):
    """As of lap k: each representative lap answers for the checkpoints up to the next one, so rows do not multiply by k."""
    df = rep_rows(c, "lap_time", "race_laps")
    df = framed(df, CAR, {"m5": lambda w: F.avg("lap_time").over(w.rowsBetween(-4, 0)), "nxt": lambda w: F.lead("lap").over(w)},
                order="rep_no", before=4, after=1, blk=c.blk, block_laps=c.shape.block_laps)
    lo = F.expr("greatest(5, (lap + 4) div 5 * 5)")
    hi = F.least(F.coalesce(F.col("nxt") - 1, F.col("race_laps") - 2), F.col("race_laps") - 2)
    df = df.withColumn("k", F.explode(F.when(hi >= lo, F.sequence(lo, hi, F.lit(5).cast("bigint")))))
    return df.select("race_no", "drv", "k", rnd("lap_time").alias("last_lap"), rnd("m5").alias("mean_last5"))


@query("w_13_field_stopped_fraction", feat_sql(f"""
select a.race_no, a.drv, a.lap, {R('case when count(*) > 1 then avg(case when b.stops_before > a.stops_before then 1.0 else 0.0 end) else 0.0 end')} as frac
from f a join f b on a.race_no = b.race_no and a.lap = b.lap group by all"""))
def stopped_fraction(c):
    w = Window.partitionBy("race_no", "lap")
    more = F.rank().over(w.orderBy(F.col("stops_before").desc())) - 1
    n = F.count(F.lit(1)).over(w)
    return c.laps.select(*KEY, rnd(F.when(n > 1, more / n).otherwise(F.lit(0.0))).alias("frac"))


@query("w_14_cars_stopped_previous_lap", feat_sql("""
, s as (select race_no, lap, count(*) filter (where pit_in) as n from f group by all)
select f.race_no, f.drv, f.lap, coalesce(s.n, 0) as cars_stopped_prev from f left join s on s.race_no = f.race_no and s.lap = f.lap - 1""".strip()))
def stopped_previous(c):
    s = c.laps.filter("pit_in").groupBy("race_no", (F.col("lap") + 1).alias("lap")).agg(F.count(F.lit(1)).alias("n"))
    return c.laps.select(*KEY).join(s, ["race_no", "lap"], "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("cars_stopped_prev"))


@query("w_15_lagged_field_stops", feat_sql("""
, s as (select race_no, lap, count(*) filter (where pit_in) as n from f group by all)
select race_no, lap, cast(coalesce(sum(n) over (partition by race_no order by lap range between 1 preceding and 1 preceding), 0) as bigint) as lag1,
 cast(coalesce(sum(n) over (partition by race_no order by lap range between 2 preceding and 2 preceding), 0) as bigint) as lag2,
 cast(coalesce(sum(n) over (partition by race_no order by lap range between 3 preceding and 1 preceding), 0) as bigint) as recent3 from s""".strip()))
def lagged_stops(c):
    """Looked up by lap value, not row offset."""
    s = c.laps.groupBy("race_no", "lap").agg(F.count_if("pit_in").alias("n"), F.first("blk").alias("blk"))
    at = lambda a, b: (lambda w: F.coalesce(F.sum("n").over(w.rangeBetween(a, b)), F.lit(0)))
    return framed(s, ["race_no"], {"lag1": at(-1, -1), "lag2": at(-2, -2), "recent3": at(-3, -1)}, before=3, blk=c.blk,
                  block_laps=c.shape.block_laps).select("race_no", "lap", "lag1", "lag2", "recent3")


@query("w_16_near_stops", feat_sql("""
, x as (select race_no, drv, lap, pit_in, lag(position) over (partition by race_no, drv order by lap) as pp from f)
select a.race_no, a.drv, a.lap, count(b.drv) as near_stops2 from x a left join x b on a.race_no = b.race_no and b.lap in (a.lap - 1, a.lap - 2)
  and b.pit_in and abs(b.pp - a.pp) <= 3 group by all""".strip()))
def near_stops(c):
    """Stops by cars within three places in the last two laps: each stop announces itself to the (lap, place) cells it is near."""
    x = car_frames(c, c.laps.select(*KEY, "blk", "position", "pit_in"), {"pp": lambda w: F.lag("position").over(w)}, before=1)
    cells = (x.filter("pit_in and pp is not null")
             .withColumn("lap", F.explode(F.array(F.col("lap") + 1, F.col("lap") + 2)))
             .withColumn("pp", F.explode(F.sequence(F.col("pp") - 3, F.col("pp") + 3)))
             .groupBy("race_no", "lap", "pp").agg(F.count(F.lit(1)).alias("n")))
    return x.select(*KEY, "pp").join(cells, ["race_no", "lap", "pp"], "left").select(*KEY, F.coalesce("n", F.lit(0)).alias("near_stops2"))


@query("w_17_field_age_and_compound", feat_sql(f"""
select race_no, drv, lap, {R('age - quantile_cont(age, 0.5) over (partition by race_no, lap)')} as field_age_diff,
  {R('avg(case when stops_before > 0 then 1.0 else 0.0 end) over (partition by race_no, lap, compound)')} as same_comp_frac_stopped from f"""))
def field_age(c):
    lap = Window.partitionBy("race_no", "lap")
    return c.laps.select(*KEY, rnd(F.col("age") - F.percentile("age", F.lit(0.5)).over(lap)).alias("field_age_diff"),
                         rnd(F.avg((F.col("stops_before") > 0).cast("double")).over(Window.partitionBy("race_no", "lap", "compound"))).alias("same_comp_frac_stopped"))


STATE_SQL = """st as (select race_no, circuit, lap, case when avg(case when sc then 1.0 else 0.0 end) > 0.5 then 1
  when avg(case when vsc then 1.0 else 0.0 end) > 0.5 then 2 else 0 end as state from f where lap >= 2 group by all),
pv as (select *, coalesce(lag(state) over (partition by race_no order by lap), 0) as prev from st)"""


@query("w_18_run_starts", feat_sql("select race_no, lap, state, prev, state <> prev as starts from pv", STATE_SQL))
def run_starts(c):
    from gridpace.operators.neutral import lap_states
    return lap_states(c).select("race_no", "lap", "state", "prev", (F.col("state") != F.col("prev")).alias("starts"))


@query("w_19_laps_remaining", laps_sql("""
select race_no, drv, lap, max(lap) over (partition by race_no) - lap as laps_remaining,
  tyre_life - row_number() over (partition by race_no, drv, stint order by lap) + 1 as stint_start_tyre_age from laps"""))
def laps_remaining(c):
    last = c.raw_laps.groupBy("race_no").agg(F.max("lap").alias("last"))
    first = c.raw_laps.groupBy(*CAR, "stint").agg(F.min("lap").alias("first"))
    return c.raw_laps.join(last, "race_no").join(first, [*CAR, "stint"]).select(
        *KEY, (F.col("last") - F.col("lap")).alias("laps_remaining"),
        (F.col("tyre_life") - (F.col("lap") - F.col("first") + 1) + 1).alias("stint_start_tyre_age"))


@query("w_20_stint_segments", laps_sql("""
select race_no, drv, stint, min(lap) as from_lap, max(lap) as to_lap, arg_min(compound, lap) as compound, greatest(1, arg_min(tyre_life, lap)) as start_age
from laps group by race_no, drv, stint"""))
def segments(c):
    """Gaps and islands: a new stint starts after every pit lap."""
    from gridpace.operators.field import stints_of
    return stints_of(c.raw_laps, c.blk).select("race_no", "drv", "stint", "from_lap", "to_lap", "compound", "start_age")


@query("w_21_cumulative_clock", laps_sql("select race_no, drv, lap, end_us as clock_us from laps"))
def clock(c):
    df = running(c.raw_laps.select(*KEY, "blk", "lap_us"), CAR, {"b": ("sum", F.col("lap_us"))}, blk=c.blk)
    return df.select(*KEY, (F.col("drv") * 300000 + F.coalesce("b", F.lit(0)) + F.col("lap_us")).alias("clock_us"))


@query("w_22_position_by_lap", laps_sql("""
select race_no, drv, lap, rank() over (partition by race_no, lap order by end_us) as pos from laps"""))
def position(c):
    return c.raw_laps.select(*KEY, F.rank().over(Window.partitionBy("race_no", "lap").orderBy("end_us")).cast("bigint").alias("pos"))


FIELD_SQL = """fp as (
  select race_no, lap, quantile_cont(case when not pit_in and not pit_out then lap_time end, 0.5) as field_med,
    case when count(*) filter (where sc) > count(*) / 2.0 then 'S' when count(*) filter (where vsc) > count(*) / 2.0 then 'V' else 'G' end as status
  from f group by all),
gp0 as (
  select *, case when status = 'G' and field_med is not null and lap > 1 then field_med end as green_med0 from fp),
gp1 as (
  select *, last_value(green_med0 ignore nulls) over a as m0, last_value(case when green_med0 is not null then lap end ignore nulls) over a as l0,
    first_value(green_med0 ignore nulls) over b as m1, first_value(case when green_med0 is not null then lap end ignore nulls) over b as l1
  from gp0 window a as (partition by race_no order by lap rows between unbounded preceding and current row),
    b as (partition by race_no order by lap rows between current row and unbounded following)),
gp as (
  select race_no, lap, field_med, status, coalesce(green_med0, case when l0 is not null and l1 is not null then m0 + (m1 - m0) * (lap - l0) / (l1 - l0)
    else coalesce(m0, m1, field_med) end) as green_med from gp1)"""


@query("w_23_green_pace_interpolated", feat_sql(f"select race_no, lap, status, {R('green_med')} as green_med from gp", FIELD_SQL))
def green_interpolated(c):
    return green_pace(c, field_pace(c)).select("race_no", "lap", "status", rnd("green_med").alias("green_med"))


@query("w_24_gaps_at_clock", laps_sql(f"""
, att as (select race_no, drv, lap, lap - 1 + cast(3000000000 - start_us as double) / lap_us as d, lap_time from laps where start_us <= 3000000000 and end_us > 3000000000)
select race_no, drv, rank() over (partition by race_no order by d desc, drv) as place, {R('d')} as progress,
  {R('(max(d) over (partition by race_no) - d) * lap_time')} as gap_leader_s,
  {R('(lag(d) over (partition by race_no order by d desc, drv) - d) * lap_time')} as gap_ahead_s,
  {R('(d - lead(d) over (partition by race_no order by d desc, drv)) * lap_time')} as gap_behind_s from att""".strip()))
def gaps_at_clock(c):
    """State of every running car 3,000 s into the race: the lap in progress is a plain filter, one row per car."""
    t = 3_000_000_000
    at = c.raw_laps.filter((F.col("start_us") <= t) & (F.col("end_us") > t)).select(
        "race_no", "drv", "lap_time", (F.col("lap") - 1 + (F.lit(t) - F.col("start_us")) / F.col("lap_us")).alias("d"))
    r = Window.partitionBy("race_no")
    w = r.orderBy(F.col("d").desc(), "drv")
    return at.select("race_no", "drv", F.rank().over(w).cast("bigint").alias("place"), rnd("d").alias("progress"),
                     rnd((F.max("d").over(r) - F.col("d")) * F.col("lap_time")).alias("gap_leader_s"),
                     rnd((F.lag("d").over(w) - F.col("d")) * F.col("lap_time")).alias("gap_ahead_s"),
                     rnd((F.col("d") - F.lead("d").over(w)) * F.col("lap_time")).alias("gap_behind_s"))
