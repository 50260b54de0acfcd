"""Registry that keeps each query next to the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# The adapters of kongrid.sources.adapters as SQL common table expressions.
G1 = """
g1s AS (SELECT event_type AS grid_id, CAST(extract('day' FROM ts) AS INTEGER) - 1 AS y,
               CAST(extract('hour' FROM ts) AS INTEGER) AS x, sum(value) AS v FROM events GROUP BY 1, 2, 3),
g1 AS (SELECT i.grid_id, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, coalesce(s.v, 0.0) AS v
       FROM (SELECT DISTINCT event_type AS grid_id FROM events) i
       CROSS JOIN (SELECT unnest(range(30)) AS y) a CROSS JOIN (SELECT unnest(range(24)) AS x) b
       LEFT JOIN g1s s ON s.grid_id = i.grid_id AND s.y = a.y AND s.x = b.x)"""
G2 = """
g2 AS (SELECT vec_id AS grid_id, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x,
              CAST(e AS DOUBLE) AS v
       FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings))"""
G3 = """
g3 AS (SELECT l_returnflag || l_linestatus AS grid_id, CAST(l_quantity AS INTEGER) AS y,
              CAST(round(l_discount * 100) AS INTEGER) AS x, sum(l_extendedprice) AS v
       FROM lineitem GROUP BY 1, 2, 3)"""
SECONDS = "(extract('hour' FROM ts) * 3600 + extract('minute' FROM ts) * 60 + extract('second' FROM ts))"
D1 = f"""
d1 AS (SELECT event_type AS grid_id, event_id, {SECONDS} / 240.0 AS angle, value AS weight FROM events)"""
C1 = """
c1 AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'cand' ELSE 'ref' END AS grid_id, CAST(vec_id // 250 AS VARCHAR) AS pair_id, vec_id AS kp_id, label,
              CAST(sum(CASE WHEN e <= 0 THEN CAST(0 AS HUGEINT)
                            WHEN p = 64 THEN CAST(-9223372036854775808 AS HUGEINT)
                            ELSE CAST(1 AS HUGEINT) << CAST(p - 1 AS INTEGER) END) AS BIGINT) AS d
       FROM (SELECT vec_id, label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS p FROM embeddings)
       GROUP BY 1, 2, 3, 4)"""
V1 = "v1 AS (SELECT l_orderkey, l_linenumber, l_returnflag AS grp, l_extendedprice AS v FROM lineitem)"
COLORS = """
colors AS (SELECT p_partkey, CAST(p_partkey * 7 % 256 AS DOUBLE) AS b, CAST(p_size * 37 % 256 AS DOUBLE) AS g,
                  CAST(floor(p_retailprice) % 256 AS DOUBLE) AS r FROM part)"""
R1 = "r1 AS (SELECT user_id AS session, event_id AS seq, ts, event_type AS param, value FROM events)"


def wrap(expr: str) -> str:
    return f"((((({expr}) + 180.0) % 360.0) + 360.0) % 360.0 - 180.0)"
