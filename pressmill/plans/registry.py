"""All queries over the reference operators, by name, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressmill.plans import document_queries, page_queries, site_queries, url_queries

_PARTS = (url_queries, document_queries, page_queries, site_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: q for part in _PARTS for name, q in part.ORACLES.items()}
