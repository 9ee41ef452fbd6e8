"""Laps of short races cross the network once between the lap view and the feature table, in as many parts as they need."""

import re

from gridpace.constants import PART_LAPS
from gridpace.operators.features import prepare
from gridpace.registry import Context
from gridpace.sources.lapview import LABELS, LapShape, labelled


def test_one_shuffle_of_laps(spark, ctx):
    df = labelled(prepare(ctx, ctx.raw_laps.drop(*LABELS)))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    plan = df._jdf.queryExecution().executedPlan().toString() if "Exchange" not in plan else plan
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    laps = [x for x in dealt if "wt_us" not in x]
    assert len(laps) == 1 and laps[0].startswith("race_no")


def test_parts_grow_with_the_laps(spark):
    c = Context(spark, "/nowhere")
    c.shape = LapShape(10, 50, 4096, 100 * PART_LAPS + 1)
    assert c.parts == 101
