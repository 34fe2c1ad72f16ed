"""All registered queries over the driver's tables, with the SQL that checks each."""

from __future__ import annotations

from . import dedup_queries, rank_queries, time_queries
from .base import Query

REGISTRIES = (time_queries.REG, dedup_queries.REG, rank_queries.REG)
QUERIES: dict[str, Query] = {k: v for r in REGISTRIES for k, v in r.queries.items()}
ORACLE_SQL: dict[str, str] = {k: v for r in REGISTRIES for k, v in r.sql.items()}
