"""Registry of checked queries: a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query.  ``sql`` follows the CTEs of ``views``: it starts with SELECT or with ", cte AS"."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views.split())
            head = f"WITH {ctes} " if ctes else ""
            body = sql.strip()
            if not ctes and body.startswith(","):
                head, body = "WITH ", body[1:]
            ORACLES[name] = head + body
        return fn

    return add


# --- DuckDB spellings of the scalar rules -----------------------------------------

def r2(x: str) -> str:
    return f"(round_even(({x})*100,0)/100)"


def ratio(n: str, d: str) -> str:
    return f"(CAST({n} AS DOUBLE)/nullif(CAST({d} AS DOUBLE),0))"


def div2(n: str, d: str) -> str:
    return r2(ratio(n, d))


def total(x: str) -> str:
    return f"(CAST(sum(CAST(round_even(CAST({x} AS DOUBLE)*1e6,0) AS BIGINT)) AS DOUBLE)/1e6)"
