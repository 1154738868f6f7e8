"""Dense order numbers without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut


def numbered(rows: DataFrame, order: list[str], name: str = "ord") -> DataFrame:
    """rows with their place (from 0) in the global order of the columns, which have to be unique together.

    Rows are range-partitioned; each partition is numbered for itself and shifted by the counts before it.
    """
    placed = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    placed = cut(placed)
    counts = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())  # a row a partition
    if not counts:
        return rows.withColumn(name, F.lit(0).cast("long"))
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total).cast("long")]
        total += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn(name, (own + F.create_map(*offsets)[F.col("_part")]).cast("long")).drop("_part")


def numbered_within(rows: DataFrame, by: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """rows with their place (from 0) within their group, by order; the columns of both have to be unique together.

    One global order with each group's first place taken off, so that a group of any size is many tasks.
    """
    out = numbered(rows, list(dict.fromkeys([*by, *order])), name)
    if not by:
        return out
    first = out.groupBy(*by).agg(F.min(name).alias("_first")).withColumnsRenamed({b: f"_{b}" for b in by})
    on = None
    for b in by:
        one = F.col(b).eqNullSafe(F.col(f"_{b}"))
        on = one if on is None else on & one
    return out.join(first, on).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_{b}" for b in by])


def running_total(rows: DataFrame, by: list[str], order: str, value: str, name: str = "upto") -> DataFrame:
    """rows with the running sum of value within their group, in order (distinct within a group), and the group's `total`.

    Sums of a range partition are carried over to the later ones, so a group of any size is many tasks.
    """
    placed = cut(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by)
    parts = parts.select("_part", *by, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.sum("_sum").over(every).alias("total"))
    parts = parts.withColumnsRenamed({c: f"_{c}" for c in ["_part", *by]})
    on = F.col("_part") == F.col("__part")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    out = placed.withColumn(name, F.sum(value).over(own)).join(parts, on)
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "__part", "_before", *[f"_{b}" for b in by])
