"""The green / SC / VSC lap-state chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpace.constants import GREEN, SC, VSC
from gridpace.operators.scan import framed


def lap_states(ctx, laps: DataFrame | None = None) -> DataFrame:
    """Majority state of each lap from the second on, with the state of the lap before (green at the start)."""
    f = (ctx.laps if laps is None else laps).filter("lap >= 2")
    share = lambda x: F.avg(F.col(x).cast("double"))
    s = f.groupBy("race_no", "circuit", "lap").agg(
        F.when(share("sc") > 0.5, SC).when(share("vsc") > 0.5, VSC).otherwise(GREEN).alias("state"), F.first("blk").alias("blk"))
    return framed(s, ["race_no"], {"prev": lambda w: F.coalesce(F.lag("state").over(w), F.lit(GREEN))}, before=1, blk=ctx.blk,
                  block_laps=ctx.shape.block_laps)


def neutral_table(states: DataFrame, prior_laps: int = 200) -> DataFrame:
    """Onset hazards per circuit shrunk to the global rate, and mean lengths; ``_global`` is a row."""
    risk = F.col("prev") == GREEN
    per = states.groupBy("circuit").agg(
        F.count_if(risk).alias("n"), F.count_if(risk & (F.col("state") == SC)).alias("on_sc"),
        F.count_if(risk & (F.col("state") == VSC)).alias("on_vsc"),
        *[F.count_if(F.col("state") == s).alias(f"laps_{k}") for s, k in ((SC, "sc"), (VSC, "vsc"))],
        *[F.count_if((F.col("state") == s) & (F.col("prev") != s)).alias(f"runs_{k}") for s, k in ((SC, "sc"), (VSC, "vsc"))])
    ratio = lambda a, b: F.sum(a) / F.sum(b)
    g = per.agg(ratio("on_sc", "n").alias("g_sc"), ratio("on_vsc", "n").alias("g_vsc"),
                *[(F.sum(f"laps_{k}") / F.greatest(F.sum(f"runs_{k}"), F.lit(1))).alias(f"len_{k}") for k in ("sc", "vsc")])
    g = g.withColumn("one", F.lit(1))
    shrink = lambda on, gl: (F.col(on) + prior_laps * F.col(gl)) / (F.col("n") + prior_laps)
    rows = per.withColumn("one", F.lit(1)).join(F.broadcast(g), "one").filter("n > 0")  # g is one row
    local = rows.select("circuit", shrink("on_sc", "g_sc").alias("p_sc"), shrink("on_vsc", "g_vsc").alias("p_vsc"),
                        "len_sc", "len_vsc", F.col("n").alias("laps_at_risk"))
    glob = g.select(F.lit("_global").alias("circuit"), F.col("g_sc").alias("p_sc"), F.col("g_vsc").alias("p_vsc"), "len_sc", "len_vsc",
                    F.lit(None).cast("bigint").alias("laps_at_risk"))
    return local.unionByName(glob)


def transition_matrix(p_sc: Column, p_vsc: Column, len_sc: Column, len_vsc: Column) -> Column:
    """3 x 3 lap-state transition matrix as nested arrays."""
    q = lambda n: 1 - 1 / F.greatest(n, F.lit(1.01))
    z = F.lit(0.0)
    return F.array(F.array(1 - p_sc - p_vsc, p_sc, p_vsc), F.array(1 - q(len_sc), q(len_sc), z), F.array(1 - q(len_vsc), z, q(len_vsc)))
