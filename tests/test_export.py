"""The model export has the shared terms and every bootstrap replicate."""

import json

from gridpace.operators import bundle
from gridpace.plans.decide import model_export


def test_export_is_whole(ctx):
    docs = {r["circuit"]: json.loads(r["doc"]) for r in model_export(ctx).collect()}
    whole, mod = docs.pop("_global"), bundle.model(ctx)
    assert whole["fuel"] == round(mod.coef("fuel", "fuel"), 5) and whole["sigma"] == round(float(mod.sigma[0]), 3)
    assert whole["terms"]["cold:HARD"] == mod.coef("cold", "HARD")
    assert [b["replicate"] for b in whole["boots"]] == sorted(bundle.boots(ctx).shared) and len(whole["boots"]) == bundle.REPLICATES
    assert docs and any(len(d.get("boots", [])) > 0 for d in docs.values())
