"""Named queries (one per operator of the inventory) and their DuckDB oracles."""
from trialscope.plans.registry import ORACLE, QUERIES, finish
from trialscope.plans import q_clean, q_describe, q_draws, q_extra, q_models, q_parts  # noqa: F401  (registers)

__all__ = ["QUERIES", "ORACLE", "finish"]
