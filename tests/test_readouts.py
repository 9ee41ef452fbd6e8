"""Read-outs of the model and the policy against plain pandas over the tables that they read."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridpace.constants import DRY, KNOTS
from gridpace.operators import bundle, decisions
from gridpace.operators.policy import POLICY, policy_rows, shared_terms
from gridpace.plans import load_all
from gridpace.registry import QUERIES

load_all()
STATE = ["circuit", "lap", "c", "a", "f", "s"]
FEW = 3


@pytest.fixture(scope="module")
def few(ctx):
    return bundle.boots(ctx, FEW)


@pytest.fixture(scope="module")
def asked(ctx):
    return decisions.states(ctx).select("race_no", "drv", "circuit", "lap", F.col("comp").alias("c"), "a", "f", "s").toPandas()


def test_votes_are_the_rows_of_each_replicates_whole_policy(ctx, few, asked):
    got = decisions.votes(ctx, FEW).toPandas()
    p = bundle.circuit_params(ctx).drop("circ_coef").join(few.circuits, "circuit").join(decisions.longest_races(ctx), "circuit")
    some = sorted(asked["circuit"].unique())[:3]
    c = p.filter(F.col("circuit").isin(*some)).select("replicate", "circuit", F.lit(2).alias("n_from"), F.col("longest").cast("int").alias("n_laps"), "l_scale",
                                                      "track_temp", "circ_coef", "pit_loss", "chain", "max_age")
    whole = c.mapInPandas(policy_rows(shared_terms(few)), POLICY).toPandas()
    want = asked[STATE].drop_duplicates().merge(whole, on=STATE)
    both = want.merge(got, on=["replicate", *STATE], suffixes=("", "_got"))
    assert len(both) == len(want) > 0 and (both["action"] == both["action_got"]).all()
    drawn = few.circuits.select("replicate", "circuit").toPandas()  # a replicate has the circuits of its races
    seen = asked[STATE].drop_duplicates().merge(drawn, on="circuit")
    assert len(got) == len(seen) and not got.duplicated(["replicate", *STATE]).any() and got["action"].notna().all()


def test_policy_lookup_counts_and_means(ctx, asked):
    policy = decisions.policy_table(ctx).toPandas()
    j = asked.merge(policy, on=STATE)
    assert len(j) == len(asked)  # every state has its row
    want = j.assign(g=j["stay"] - j["pit"], call=j["action"] >= 0).groupby(["circuit", "lap"]).agg(states=("g", "size"), calls=("call", "sum"), mean_gain=("g", "mean"))
    got = QUERIES["j_12_policy_lookup"](ctx).toPandas().set_index(["circuit", "lap"]).sort_index()
    pd.testing.assert_frame_equal(got[["states", "calls"]].astype("int64"), want[["states", "calls"]].astype("int64"))
    np.testing.assert_allclose(got["mean_gain"], want["mean_gain"], rtol=1e-9, atol=1e-9)
    stop = policy[policy["action"] >= 0].groupby(["circuit", "lap", "c", "f", "s"])["a"].agg(["min", "size"])
    table = QUERIES["d_02_policy_table"](ctx).toPandas().set_index(["circuit", "lap", "c", "f", "s"])
    some = table[table["stopping_ages"] > 0].sort_index()
    assert (some["stop_from_age"] == stop["min"]).all() and (some["stopping_ages"] == stop["size"]).all()


def test_bands_are_quantiles_of_the_replicates_curves(ctx, few, monkeypatch):
    monkeypatch.setattr(bundle, "boots", lambda c, n=FEW: few)
    got = QUERIES["a_30_bootstrap_bands"](ctx).toPandas().set_index(["circuit", "compound", "age"])
    t = few.shared_table().toPandas()
    shared = {(r.replicate, r.block, r.key): r.value for r in t[t.circuit.isna()].itertuples()}
    own = {(r.replicate, r.circuit, r.block, r.key): r.value for r in t[t.circuit.notna()].itertuples()}
    drawn = t.dropna(subset=["circuit"]).groupby("circuit")["replicate"].unique()
    circuits = sorted(drawn.index)
    assert len(got) == len(circuits) * len(DRY) * 40
    for circuit in circuits[:4]:
        for comp in DRY:
            for age in (1, 4, 11, 29, 40):
                values = []
                for r in drawn[circuit]:
                    bends = [max(age - k, 0) for k in KNOTS]
                    curve = sum(b * shared.get((r, "deg0" if j == 0 else "deg", f"{comp}:{j}"), 0.0) for j, b in enumerate(bends))
                    values.append(shared.get((r, "off_g", comp), 0.0) + own.get((r, circuit, "off_circ", comp), 0.0) + curve + age * own.get((r, circuit, "deg_circ", comp), 0.0))
                np.testing.assert_allclose(got.loc[(circuit, comp, age)].to_numpy(float), np.quantile(values, [0.05, 0.95]), rtol=1e-9, atol=1e-12)
