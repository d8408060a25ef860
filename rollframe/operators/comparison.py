"""Objective modes of runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The objective aggregation modes.
MODES = ["token", "turn", "trajectory"]


def objective_mode(weighting: Column, configured: Column, method: Column) -> Column:
    """Explicit weighting, then the configured mode, then what the method name says."""
    said, low = F.lower(weighting), F.lower(F.coalesce(method, F.lit("")))
    named = (F.when(low.contains("token"), "token").when(low.contains("turn"), "turn")
             .when(low.contains("trajectory") | low.contains("episode"), "trajectory").otherwise("unknown"))
    return F.coalesce(F.when(said.isin(MODES), said), F.nullif(F.lower(configured), F.lit("")), named)
