"""Importing this module registers every query."""

from stockloom.plans.registry import ORACLES, QUERIES
from stockloom.plans import (  # noqa: F401
    q_cleaning,
    q_clustering,
    q_effects,
    q_forecast,
    q_functions,
    q_inventory,
    q_models,
    q_relational,
    q_sources,
    q_stats,
)

__all__ = ["ORACLES", "QUERIES"]
