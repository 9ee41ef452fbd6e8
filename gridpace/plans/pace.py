"""Clean car pace (C-01)."""

from __future__ import annotations

from gridpace.functions.expr import rnd
from gridpace.operators.field import clean_pace
from gridpace.plans.sqltext import feat_sql
from gridpace.plans.sqltext import rnd as R
from gridpace.plans.windows import FIELD_SQL
from gridpace.registry import query

KEY = ["race_no", "drv", "lap"]

CLEAN_SQL = FIELD_SQL + """,
cd as (select f.race_no, f.drv, f.lap, f.lap_time, f.pit_in, f.pit_out, f.rep, gp.field_med, gp.green_med from f join gp using (race_no, lap)),
co as (select race_no, drv, coalesce(quantile_cont(case when rep and field_med is not null then lap_time - field_med end, 0.5), 0) as off from cd group by all),
cl as (select cd.*, off, case when pit_in or pit_out then least(lap_time, coalesce(field_med, green_med) + off) else lap_time end as clean from cd join co using (race_no, drv))"""


@query("c_01_clean_pace", feat_sql(f"select race_no, drv, lap, {R('clean', 5)} as clean, {R('off', 5)} as car_offset from cl", CLEAN_SQL))
def clean(c):
    cols = [*KEY, "blk", "lap_time", "pit_in", "pit_out", "rep"]
    return clean_pace(c, c.laps.select(*cols)).select(*KEY, rnd("clean", 5).alias("clean"), rnd("off", 5).alias("car_offset"))
