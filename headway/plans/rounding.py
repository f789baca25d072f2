"""Rounding of sums and means, so that engines which add in another order agree."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

DIGITS = 6


def rounded_queries(queries: dict, columns: dict[str, list[str]]) -> dict:
    def wrapped(query, names):
        @wraps(query)
        def run(spark, sf_dir):
            return query(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in names})

        return run

    return {k: wrapped(q, columns[k]) if k in columns else q for k, q in queries.items()}


def rounded_sql(sql: dict[str, str], columns: dict[str, list[str]]) -> dict[str, str]:
    replace = lambda names: ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in names)
    return {k: f"SELECT * REPLACE ({replace(columns[k])}) FROM ({s})" if k in columns else s for k, s in sql.items()}
