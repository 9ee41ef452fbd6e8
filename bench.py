"""Benchmark: seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``stage_*``, ``fit_*`` and ``solve_*`` build the shared tables from the given
tables once, cold; the other queries are the median of three warm runs that
read the staged feature table. BENCH_ALL=1 adds the bootstrap, its votes and the policy table.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gridpace import plans
from gridpace.operators import bundle, decisions
from gridpace.registry import QUERIES, Context
from gridpace.session import clear_staged, local_session

plans.load_all()

BUILD = [
    ("stage_lap_view", lambda c: c.raw_laps),
    ("stage_features", lambda c: c.laps),
    ("fit_model", bundle.model),
    ("fit_asof_every_lap", bundle.asof_terms),
    ("fit_pit_and_circuit_tables", bundle.circuit_params),
    ("solve_all_pit_decisions", decisions.solved),
]
# longer builds, timed with BENCH_ALL=1
LONG = [("fit_30_bootstrap_replicates", bundle.boots), ("vote_on_all_states", decisions.votes), ("solve_policy_table", decisions.policy_table)]
WARM = ["p_10_representative_laps", "j_01_asof_weather_backward", "j_03_dimension_lookup", "j_06_anti_join_controls", "j_07_position_neighbours", "j_09_rejoin_position",
        "w_05_gap_ahead", "w_06_previous_lap_context", "w_11_pace_drop", "w_12_last_and_mean_of_five", "w_16_near_stops", "w_23_green_pace_interpolated",
        "a_01_group_statistics", "a_07_gap_matched_loss", "a_11_onset_hazards", "a_21_horizon_error_table", "a_23_roc_auc", "a_25_tolerant_precision_recall",
        "a_32_eda_summaries", "m_02_design_entries", "m_22_decision_features", "d_12_forecast_backtest_naive", "g_02_arc_length", "c_01_clean_pace"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "bench")
    c = Context(spark, sf_dir)
    c.table("lineitem").count()
    times: dict[str, float] = {}
    for name, build in BUILD + (LONG if os.environ.get("BENCH_ALL") else []):
        t = time.time()
        build(c)
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    for name in WARM:
        if only and name not in only:
            continue
        runs = []
        for i in range(4):
            t = time.time()
            QUERIES[name](c).write.format("noop").mode("overwrite").save()
            if i:  # the first run warms up
                runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    clear_staged(spark)


if __name__ == "__main__":
    main()
