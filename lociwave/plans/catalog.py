"""All named queries and their DuckDB counterparts."""

from __future__ import annotations

from lociwave.plans import alignments, catalogue, diversity, files, orthologs, profiles, workspaces  # noqa: F401
from lociwave.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
