"""The engine's own queries by name, and the SQL they are held against."""

from __future__ import annotations

from orrery.plans import core, more, structure  # noqa: F401  each module registers its queries
from orrery.plans.catalog import ORACLES, QUERIES

FLAGSHIP = "jn01_exact_knn"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
