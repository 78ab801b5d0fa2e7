"""All queries outside the training-data package."""

from __future__ import annotations

from orrery.plans import aggregates, catalog, diagnostics, documents, graphs, history, incremental, joins, nested, reports, searching, storage, texts, vectors  # noqa: F401
from orrery.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
