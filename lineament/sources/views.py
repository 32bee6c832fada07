"""Geospatial views derived from the stored star-schema tables.

They stand in for lines, rasters, polygons and point clouds: fixed arithmetic on
keys and measures, with no random part, so that any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineament.plans.storage import partitions


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, z): a raster 100 cells wide; null is nodata."""
    return stored(spark, sf_dir, "orders").selectExpr(
        "cast(floor(o_orderkey / 100) as bigint) as r", "o_orderkey % 100 as c", "case when o_orderstatus = 'P' then null else o_totalprice / 500000D * 28 end as z"
    )


def vertices(spark: SparkSession, sf_dir: str, rows_a_task: int | None = None) -> DataFrame:
    """(line_id, seq, x, y): the vertices of polylines in order; with rows_a_task, lines are dealt to as many tasks as that asks for."""
    rows = stored(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    if rows_a_task:  # the number of rows is in the files' footers
        rows = rows.repartition(max(partitions(spark), -(-rows.count() // rows_a_task)), "l_orderkey")
    return rows.selectExpr(
        "l_orderkey as line_id",
        "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as bigint) as seq",
        "(l_orderkey % 90) + l_quantity / 5 as x",
        "(cast(floor(l_orderkey / 90) as bigint) % 140) + l_extendedprice / 10500 as y",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, h): trees."""
    return stored(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "cast(c_custkey * 37 % 1000 as double) / 10 as x", "cast(c_custkey * 53 % 1500 as double) / 10 as y", "c_acctbal / 1000 as h"
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x0, y0, x1, y1, ecosite): axis-aligned polygons."""
    return stored(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as id",
        "s_suppkey * 17 % 90 as x0",
        "s_suppkey * 29 % 140 as y0",
        "s_suppkey * 17 % 90 + 5 + s_nationkey % 10 as x1",
        "s_suppkey * 29 % 140 + 5 + s_nationkey % 7 as y1",
        "concat('E', s_nationkey) as ecosite",
    )


def las(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, z, intensity, cls, nret): LiDAR returns."""
    return stored(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey % 100 + l_discount * 5 as x",
        "l_suppkey % 100 + l_tax * 5 as y",
        "l_quantity * 0.6D as z",
        "l_extendedprice as intensity",
        "case l_returnflag when 'R' then 2 when 'A' then 1 else 7 end as cls",
        "l_linenumber as nret",
    )


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ecosite, rings, x0, y0, x1, y1): slanting convex quadrilaterals and their bounds."""
    ring = "array(named_struct('x', x0 + 0D, 'y', y0 + 0D), named_struct('x', x1 + 0D, 'y', y0 + 1.5D), named_struct('x', x1 - 2D, 'y', y1 + 1D), named_struct('x', x0 - 1D, 'y', y1 - 2D))"
    return boxes(spark, sf_dir).selectExpr("id", "ecosite", f"array({ring}) as rings", "x0 - 1D as x0", "y0 + 0D as y0", "x1 + 0D as x1", "y1 + 1D as y1")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, rings): five by five rectangles side by side, from the nations."""
    n = "cast(n_nationkey as bigint)"
    base = stored(spark, sf_dir, "nation").selectExpr(f"{n} as id", f"10D + 15 * ({n} % 5) as x0", f"10D + 20 * floor({n} / 5) as y0")
    return base.selectExpr("id", "array(array(named_struct('x', x0, 'y', y0), named_struct('x', x0 + 15, 'y', y0), named_struct('x', x0 + 15, 'y', y0 + 20), named_struct('x', x0, 'y', y0 + 20))) as rings")


#: The same views as DuckDB common table expressions.
CTE = {
    "v_cells": "SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS r, o_orderkey % 100 AS c, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 500000 * 28 END AS z FROM orders",
    "v_vertices": "SELECT l_orderkey AS line_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS seq, "
    "(l_orderkey % 90) + l_quantity / 5 AS x, (CAST(floor(l_orderkey / 90) AS BIGINT) % 140) + l_extendedprice / 10500 AS y FROM lineitem",
    "v_points": "SELECT c_custkey AS id, CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS x, CAST(c_custkey * 53 % 1500 AS DOUBLE) / 10 AS y, c_acctbal / 1000 AS h FROM customer",
    "v_boxes": "SELECT s_suppkey AS id, s_suppkey * 17 % 90 AS x0, s_suppkey * 29 % 140 AS y0, s_suppkey * 17 % 90 + 5 + s_nationkey % 10 AS x1, s_suppkey * 29 % 140 + 5 + s_nationkey % 7 AS y1, concat('E', s_nationkey) AS ecosite FROM supplier",
    "v_las": "SELECT l_partkey % 100 + l_discount * 5 AS x, l_suppkey % 100 + l_tax * 5 AS y, l_quantity * 0.6 AS z, l_extendedprice AS intensity, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 7 END AS cls, l_linenumber AS nret FROM lineitem",
    "v_quads": "SELECT id, ecosite, [{'x': CAST(x0 AS DOUBLE), 'y': CAST(y0 AS DOUBLE)}, {'x': CAST(x1 AS DOUBLE), 'y': y0 + 1.5}, {'x': CAST(x1 - 2 AS DOUBLE), 'y': CAST(y1 + 1 AS DOUBLE)}, {'x': CAST(x0 - 1 AS DOUBLE), 'y': CAST(y1 - 2 AS DOUBLE)}] AS ring, x0 - 1 AS x0, y0, x1, y1 + 1 AS y1 FROM v_boxes",
    "v_zones": "SELECT id, x0, y0, x1, y1, [{'x': x0, 'y': y0}, {'x': x1, 'y': y0}, {'x': x1, 'y': y1}, {'x': x0, 'y': y1}] AS ring FROM (SELECT *, x0 + 15 AS x1, y0 + 20 AS y1 FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(10 + 15 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST(10 + 20 * floor(n_nationkey / 5) AS DOUBLE) AS y0 FROM nation))",
    "v_segs": "SELECT line_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM v_vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)",
}


def with_views(sql: str, *names: str) -> str:
    """sql behind the named views."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names) + " " + sql
