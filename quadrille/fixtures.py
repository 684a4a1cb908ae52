"""Deterministic layers derived from the star-schema tables (EPSG:3857 metres)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

B1 = (-9000000.0, -8000000.0, 7000000.0, 11000000.0)
B2 = (1000000.0, 2000000.0, 1500000.0, 2600000.0)
B3 = (3e7, 3e7, 4e7, 4e7)
# The pentagon of every order, closed.
PENTAGON = [(0, 10), (8, 4), (6, -9), (-7, -8), (-10, 3), (0, 10)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, flag, status, qty)"""
    return _read(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS id",
        "((l_orderkey * 7919777 + l_linenumber * 104729 + l_partkey * 31) % 40000000) - 20000000 + 0.37D AS x",
        "((l_partkey * 6151 + l_suppkey * 3571 + l_orderkey * 15485863) % 40000000) - 20000000 + 0.61D AS y",
        "l_returnflag AS flag", "l_linestatus AS status", "CAST(l_quantity AS INT) AS qty",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, coords, etype): runs of up to eight vertices of one user's events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    v = _read(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w) - 1)
    v = v.selectExpr(
        "user_id * 100000 + CAST(floor(rn / 8) AS BIGINT) AS id", "CAST(rn % 8 AS INT) AS vertex", "event_type",
        "((user_id * 7919000) % 36000000) - 18000000 + ((event_id * 7919) % 200000) - 100000 + 0.37D AS x",
        "((user_id * 6151000) % 36000000) - 18000000 + ((event_id * 3571) % 200000) - 100000 + 0.61D AS y",
    )
    runs = v.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("vertex", "x", "y", "event_type"))).alias("v"))  # eight vertices at most
    return runs.where("size(v) > 1").select("id", F.expr("transform(v, p -> named_struct('x', p.x, 'y', p.y))").alias("coords"), F.expr("v[0].event_type").alias("etype"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, part, ring, coords, status, prio, size)"""
    at = ", ".join(f"named_struct('x', ((o_orderkey * 7919000) % 36000000) - 18000000 + {dx} * ((o_custkey % 50) + 5) * 100 + 0.37D, 'y', ((o_orderkey * 6151000) % 36000000) - 18000000 + {dy} * ((o_custkey % 50) + 5) * 100 + 0.61D)" for dx, dy in PENTAGON)
    return _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "0 AS part", "0 AS ring", f"array({at}) AS coords", "o_orderstatus AS status", "o_orderpriority AS prio", "CAST(o_custkey % 50 AS INT) AS size")
