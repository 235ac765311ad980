"""Registry of the library's own queries and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from . import domain, edges, grids, groups, joins, more, scalars, stats, tables  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

FLAGSHIP = "table_pipeline"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
