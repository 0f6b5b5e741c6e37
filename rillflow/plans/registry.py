"""Where queries are registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillflow.sources.tables import FLOW_SQL, PACKET_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Preludes of the SQL texts: packets p, sessions s of 6 hours, flows f.
P = f"p AS ({PACKET_SQL})"
S = P + """,
    g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w >= 21600000000 THEN 1 ELSE 0 END AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t_us, pkt_no)),
    s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY t_us, pkt_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g)"""
L = f"f AS ({FLOW_SQL})"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
