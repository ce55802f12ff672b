"""All registered queries over the given tables, and their SQL."""

from __future__ import annotations

from cueforge.plans import q_columns, q_cues, q_files, q_jobs  # noqa: F401  they register their queries
from cueforge.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
