"""Each registered query against its DuckDB oracle on the smallest fixture (sf0.001).

The full set runs with TRIALSCOPE_ALL=1; by default a representative slice runs.
"""
import os

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle_check import compare, duck

SLICE = ["A1_read_trials", "B7_repair_decision", "B19_censor", "B33_condition_name", "C4_drop_combinations",
         "C6_join_rounded", "D9_worker_quality", "D11_exclusion_rates", "D18_strategy_table", "D22_quantiles",
         "D24_histogram", "E2_top_n_per_group", "E7_to_long", "G1_fitted_draws", "G5_compare_levels",
         "G10_mean_qi", "G17_pit_residuals", "G20_rhat", "H1_llo_fit", "H3_llo_shrink", "H9_bootstrap_draws",
         "I7_optimal_bet", "I13_heuristic_table", "I15_replay_payoffs", "F7_softmax", "F11_quantile_draws"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("TRIALSCOPE_ALL") else SLICE


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SMALL, name, E.queries()[name], E.oracle_sql()[name])
    assert r["status"] == "ok", r
