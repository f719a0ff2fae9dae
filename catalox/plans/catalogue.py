"""All named queries of the library itself."""

from __future__ import annotations

from catalox.plans import listings, reads, scalars, versions  # noqa: F401
from catalox.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
