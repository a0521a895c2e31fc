"""Registered queries: one per operator of the survey inventory.

Every query reads the driver's tables (whole tables, whole texts) and returns
a DataFrame; where a DuckDB form exists it is registered next to it.  Computed
columns carry the same names in both; doubles are rounded to 6 decimals.
"""

from __future__ import annotations

from . import q_data, q_models, q_tagging, q_text, q_vectors  # noqa: F401  (registers)
from .registry import ORACLES, QUERIES, register

__all__ = ["QUERIES", "ORACLES", "register"]
