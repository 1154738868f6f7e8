"""Voxel views: the labelled volume that the driver's tables stand for, one row for each voxel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEPTH_ROWS, HEIGHT, WIDTH = 5000, 100, 50


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, z, y, x, lin, intensity, gt, label, pred, cls over orders: sections of 100 by 50 voxels.

    gt is a block label, label is gt with holes, pred is label with errors, cls a class of the label.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lin = F.col("o_orderkey").cast("long")
    base = o.select(
        lin.alias("lin"),
        F.expr("cast(o_orderkey div 5000 as int)").alias("z"),
        F.expr("cast((o_orderkey div 50) % 100 as int)").alias("y"),
        F.expr("cast(o_orderkey % 50 as int)").alias("x"),
        F.col("o_totalprice").cast("double").alias("intensity"),
        "o_orderstatus",
        "o_orderpriority",
    )
    base = base.withColumn("gt", F.expr("cast(1 + ((y div 8) * 7 + (x div 8)) % 5 as bigint)"))
    base = base.withColumn("label", F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(F.col("gt")).cast("long"))
    pred = F.when(F.substring("o_orderpriority", 1, 1) == "1", F.col("label") % 5 + 1).otherwise(F.col("label"))
    base = base.withColumn("pred", pred.cast("long")).withColumn("cls", (F.col("label") % 3).cast("int"))
    return base.select(F.col("z").alias("sample_id"), "z", "y", "x", "lin", "intensity", "gt", "label", "pred", "cls")


#: The same view in DuckDB, as the start of a WITH clause.
VOXELS_SQL = """WITH v0 AS (SELECT CAST(o_orderkey AS BIGINT) AS lin, CAST(o_orderkey // 5000 AS INT) AS z, CAST((o_orderkey // 50) % 100 AS INT) AS y,
 CAST(o_orderkey % 50 AS INT) AS x, CAST(o_totalprice AS DOUBLE) AS intensity, o_orderstatus, o_orderpriority FROM orders),
v1 AS (SELECT *, CAST(1 + ((y // 8) * 7 + (x // 8)) % 5 AS BIGINT) AS gt FROM v0),
v2 AS (SELECT *, CAST(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE gt END AS BIGINT) AS label FROM v1),
v AS (SELECT z AS sample_id, z, y, x, lin, intensity, gt, label,
 CAST(CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN label % 5 + 1 ELSE label END AS BIGINT) AS pred, CAST(label % 3 AS INT) AS cls FROM v2)"""
