"""Operators on DataFrames that Spark has no single function for."""

from .intervals import overlap_join, overlap_totals
from .joins import as_of_join, interval_join, salted_join
from .reach import reachable
from .ranking import framed, placed, ranked
from .selection import modes, quantiles
from .windows import gap_sessions, top_k

__all__ = ["as_of_join", "framed", "gap_sessions", "interval_join", "modes", "overlap_join", "overlap_totals", "placed", "quantiles", "ranked", "reachable", "salted_join", "top_k"]
