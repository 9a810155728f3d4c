"""All bound queries."""

from __future__ import annotations

from decisionlog.plans import datasets, evaluation, proofs, scenes, storage, streams, whole  # noqa: F401
from decisionlog.plans.registry import ORACLE, QUERIES
from decisionlog.plans.views import Tables

__all__ = ["ORACLE", "QUERIES", "Tables"]
