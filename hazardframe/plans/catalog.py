"""All registered queries and their SQL."""

from __future__ import annotations

from hazardframe.plans import model_queries, survival_queries, table_queries, voxel_queries

_MODULES = [table_queries, survival_queries, model_queries, voxel_queries]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: q for m in _MODULES for name, q in m.ORACLE.items()}
