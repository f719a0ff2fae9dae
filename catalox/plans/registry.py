"""The table of named queries and what their SQL forms share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB form."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The records of :mod:`catalox.sources.tables` in SQL.
ASSETS = """assets AS (
    SELECT o_orderkey AS asset_id,
           replace(lower(split_part(o_orderpriority, '-', 2)), ' ', '_') || '-' || o_orderkey || '.' ||
               CASE o_orderstatus WHEN 'F' THEN 'jpg' WHEN 'O' THEN 'png' ELSE 'mp4' END AS file_name,
           CASE o_orderstatus WHEN 'F' THEN 'image/jpeg' WHEN 'O' THEN 'image/png' ELSE 'video/mp4' END AS content_type,
           o_orderdate AS photo_date,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderpriority = '5-LOW' THEN []::VARCHAR[]
                ELSE [o_orderpriority, o_orderstatus] END AS labels,
           sha256(o_custkey || '|' || o_orderstatus) AS hash,
           round(o_totalprice)::BIGINT AS size
    FROM orders)"""
PLACES = """places AS (
    SELECT c_custkey AS item_id, c_name AS file_name,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'City ' || (c_custkey % 40) || ', ' || n_name || ', ' || r_name END AS location,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN (c_custkey * 37 % 17900)::DOUBLE / 100 - 89.5::DOUBLE END AS lat,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN (c_custkey * 53 % 35900)::DOUBLE / 100 - 179.5::DOUBLE END AS lng
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SNAPSHOTS = """base AS (
    SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority,
           round(o_totalprice * 100)::BIGINT AS price, epoch(o_orderdate)::BIGINT AS ts FROM orders),
local_ AS (
    SELECT *, sha256(concat_ws('|', key, status, priority, price)) AS hash FROM base WHERE status <> 'P'),
edited AS (
    SELECT key, CASE WHEN priority = '1-URGENT' THEN status || '*' ELSE status END AS status, priority, price,
           CASE WHEN priority = '1-URGENT' THEN ts + 60 ELSE ts END AS ts
    FROM base WHERE priority <> '5-LOW'),
origin AS (SELECT *, sha256(concat_ws('|', key, status, priority, price)) AS hash FROM edited)"""
