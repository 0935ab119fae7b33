"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from tidewheel.plans import event_queries, function_queries, graph_queries, history_queries, run_queries, state_queries
from tidewheel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "event_queries", "function_queries", "graph_queries", "history_queries", "run_queries", "state_queries"]
