"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scenova.sources.scenes import OBJECTS_SQL, PAIRS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *, heads: str = ""):
    """Register a query under its function's name. ``heads`` names the common CTEs its SQL needs: o for objects, p for pairs."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ctes = [OBJECTS_SQL] * ("o" in heads or "p" in heads) + [PAIRS_SQL] * ("p" in heads)
            body = sql.strip()
            head = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
            if ctes and body.startswith(head):
                body = ", " + body[len(head) :]
            ORACLE_SQL[f.__name__] = (head + ", ".join(ctes) + "\n" if ctes else "") + body
        return f

    return keep


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row: filters and lambdas that name it later don't hold its expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))
