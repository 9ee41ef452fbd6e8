"""The fitted bundle of a data set: model, stop tables and per-circuit parameters, each staged once per session."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpace.constants import DEFAULT_TRACK_TEMP, DEV_YEARS, DRY, SC_RATIO_EFF, TRAIN_YEARS
from gridpace.operators import ridge
from gridpace.operators.asof_fit import asof_local_fits
from gridpace.operators.limits import circuit_constants, stint_limits
from gridpace.operators.neutral import lap_states, neutral_table, transition_matrix
from gridpace.operators.pit import measured_stops, pit_loss_table
from gridpace.session import stage

FIT_YEARS = TRAIN_YEARS + DEV_YEARS


def fitted_on(ctx, years: tuple[int, ...], seen: tuple[int, ...] | None = None):
    """The same laps, or those of the seasons ``seen`` only, with the bundle of other fit seasons."""
    def make():
        ctx.shape, ctx.laps  # shared from here on
        other = copy.copy(ctx)
        other._made, other.fit_years = {}, tuple(years)
        if seen is not None:
            other.laps = ctx.laps.filter(F.col("year").isin(*seen))
        return other
    return ctx.memo(f"fitted_on{tuple(years)}{seen}", make)


def before_development(ctx):
    """Training and development seasons with a bundle of the training seasons: what the development scores may know."""
    return fitted_on(ctx, TRAIN_YEARS, FIT_YEARS)


def fit_years(ctx) -> tuple[int, ...]:
    return getattr(ctx, "fit_years", tuple(FIT_YEARS))


def fit_laps(ctx) -> DataFrame:
    return ctx.laps.filter(F.col("year").isin(*fit_years(ctx)))


def model(ctx) -> ridge.Model:
    """Point fit on the seasons before the test season."""
    return ctx.memo("model", lambda: ridge.fit(fit_laps(ctx).filter("rep")))


REPLICATES = 30  # fixed value: bootstrap refits


def boots(ctx, replicates: int = REPLICATES) -> ridge.Model:
    """Race-bootstrap refits; all replicates are fitted together."""
    def make():
        rep = fit_laps(ctx).filter("rep")
        w = stage(ridge.bootstrap_weights(rep, replicates), "boot-weights")
        return ridge.fit(rep, weights=w, replicates=replicates)
    return ctx.memo(f"boots{replicates}", make)


def local_terms(ctx) -> DataFrame:
    """Race-local terms of every race from all its representative laps."""
    return ctx.memo("local_terms", lambda: stage(ridge.local_fit(model(ctx), ctx.laps.filter("rep")), "local-terms"))


def asof_terms(ctx) -> DataFrame:
    """Race-local terms as of every lap of every race."""
    return ctx.memo("asof_terms", lambda: stage(asof_local_fits(model(ctx), ctx.laps.filter("rep")), "asof-terms"))


def model_stops(ctx) -> DataFrame:
    """Real stops measured against the model's clean in- and out-laps (no traffic, fresh out-lap)."""
    def make():
        m = model(ctx)
        f = (ctx.laps.withColumn("gap1", F.lit(0.0)).withColumn("gap2", F.lit(0.0))
             .withColumn("lap_in_stint", F.when(F.col("pit_out"), F.lit(1)).otherwise(F.col("lap_in_stint"))))
        return stage(measured_stops(ctx, m.predict_local(f, local_terms(ctx), ["race_no"], "expected")), "model-stops")
    return ctx.memo("model_stops", make)


def pit_table(ctx) -> DataFrame:
    return ctx.memo("pit_table", lambda: stage(pit_loss_table(model_stops(ctx).filter(F.col("year").isin(*fit_years(ctx)))), "pit-table"))


def neutral(ctx) -> DataFrame:
    return ctx.memo("neutral", lambda: stage(neutral_table(lap_states(ctx, fit_laps(ctx))), "neutral"))


def with_global(circuits: DataFrame, table: DataFrame, cols: list[str]) -> DataFrame:
    """Each circuit's row of a parameter table, or the table's ``_global`` row where it has none."""
    g = table.filter("circuit = '_global'").select(F.struct(*cols).alias("_g"), F.lit(1).alias("_one"))
    j = circuits.join(table.select("circuit", F.struct(*cols).alias("_l")), "circuit", "left").withColumn("_one", F.lit(1))
    j = j.join(F.broadcast(g), "_one").withColumn("_p", F.coalesce("_l", "_g"))  # one row
    return j.select(*circuits.columns, *[F.col(f"_p.{c}") for c in cols])


def circuit_params(ctx) -> DataFrame:
    """One row per circuit: scale, temperature, length, base pace, pit losses, chain and stint limits."""
    def make():
        m, laps = model(ctx), fit_laps(ctx)
        seen = circuit_constants(laps)
        # a circuit not raced before the test season keeps its length and takes default scale and temperature
        every = circuit_constants(ctx.laps).select("circuit", F.col("race_laps").alias("_len"))
        known = every.join(seen, "circuit", "left").select(
            "circuit", F.coalesce("l_scale", F.lit(1.0)).alias("l_scale"), F.coalesce("track_temp", F.lit(DEFAULT_TRACK_TEMP)).alias("track_temp"),
            F.coalesce("race_laps", "_len").alias("race_laps"))
        known = with_global(known, pit_table(ctx), ["green", "sc_ratio", "vsc_ratio", "n_green"])
        known = with_global(known, neutral(ctx), ["p_sc", "p_vsc", "len_sc", "len_vsc"])
        lim = stint_limits(laps)
        wide = lim.groupBy("circuit").agg(*[F.max(F.when(F.col("compound") == c, F.col("max_age"))).alias(c) for c in DRY])
        glob = wide.filter("circuit = '_global'").select(F.lit(1).alias("_one"), *[F.col(c).alias(f"g_{c}") for c in DRY])
        known = known.join(wide, "circuit", "left").withColumn("_one", F.lit(1)).join(F.broadcast(glob), "_one")  # one row
        known = known.withColumn("max_age", F.array(*[F.coalesce(c, f"g_{c}") for c in DRY])).drop("_one", *DRY, *[f"g_{c}" for c in DRY])
        races = laps.groupBy("circuit", "race_no").agg(F.max("year").alias("y"), F.max("round_no").alias("r"))
        has_fit = races.join(local_terms(ctx).select("race_no", "fe"), "race_no")
        last = races.groupBy("circuit").agg(F.max_by("race_no", F.struct("y", "r")).alias("race_no"))
        base = last.join(has_fit.select("race_no", "fe"), "race_no").select("circuit", F.explode("fe").alias("fe"))
        base = base.groupBy("circuit").agg(F.percentile("fe", F.lit(0.5)).alias("base"))  # the cars of one race
        known = known.join(base, "circuit", "left")
        return stage(m.with_circuit(known).select(
            "*", F.array(F.col("green"), F.col("green") * SC_RATIO_EFF, F.col("green") * F.col("vsc_ratio")).alias("pit_loss"),
            F.flatten(transition_matrix(F.col("p_sc"), F.col("p_vsc"), F.col("len_sc"), F.col("len_vsc"))).alias("chain")), "circuit-params")
    return ctx.memo("circuit_params", make)
