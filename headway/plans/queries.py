"""All queries of the analytics library, and the SQL that they must agree with."""

from __future__ import annotations

from headway.plans import matching_queries, model_queries, schedule_queries, scoring_queries, serving_queries, source_queries, trajectory_queries

MODULES = (trajectory_queries, scoring_queries, schedule_queries, serving_queries, matching_queries, model_queries, source_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
