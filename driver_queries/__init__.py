"""Registered queries of the library over the driver's star-schema tables, and their DuckDB SQL.

Fixture, not product: ``roles`` reads the driver tables as clinical tables, ``resources`` builds
bundles from them, ``oracle`` restates both in SQL. The package itself imports none of this.
"""

from .core import QUERIES, SQL
from . import etl, models  # noqa: F401  they register their queries

__all__ = ["QUERIES", "SQL"]
