"""Every registered query of the document engine and its DuckDB equivalent."""

from tessera.plans import documents, pages, tables  # noqa: F401  each module registers its queries
from tessera.plans.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
