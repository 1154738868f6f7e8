"""Instance statistics, histograms, per-instance means, percentiles and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans.rank import running_total


def instance_sizes(rows: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), label).agg(F.count(F.lit(1)).alias("size"))


def instance_count(rows: DataFrame, by: list[str], label: str = "label", with_background: bool = False) -> DataFrame:
    """Distinct labels a sample, without 0 unless asked."""
    kept = F.col(label) if with_background else F.when(F.col(label) != 0, F.col(label))
    return rows.groupBy(*by).agg(F.count_distinct(kept).alias("n_labels"))


def foreground_share(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    t = rows.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("background"), F.count_if(F.col(label) > 0).alias("foreground"), F.count(F.lit(1)).alias("n"))
    return t.select(*by, "background", "foreground", (F.col("foreground") * 100.0 / F.col("n")).alias("foreground_pct"))


def histogram(rows: DataFrame, value: str, bins: int = 50, log: bool = False) -> DataFrame:
    """(bin, low, n) of equal-width bins between the extremes; the last bin is closed on the right."""
    v = F.log(F.col(value)) if log else F.col(value).cast("double")
    values = rows.select(v.alias("v")).where("v is not null")
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # one row
    wide = (F.col("hi") - F.col("lo")) / bins
    placed = values.join(F.broadcast(ends), how="cross").withColumn("bin", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / wide), F.lit(bins - 1))).cast("int"))
    return placed.groupBy("bin").agg(F.min(F.col("lo") + F.col("bin") * wide).alias("low"), F.count(F.lit(1)).alias("n"))


def largest(rows: DataFrame, n: int = 10, label: str = "label") -> DataFrame:
    """The n largest instances; equal sizes by the smaller label."""
    return instance_sizes(rows.where(F.col(label) > 0), label).orderBy(F.desc("size"), label).limit(n)


def instance_means(rows: DataFrame, embedding: str = "embedding", label: str = "label", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, label, n, mean array<double>): the (weighted) mean vector of each positive label.

    Components are summed one by one with map-side combine, so no instance's rows meet in one task.
    """
    keys = [*(by or []), label]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = rows.where(F.col(label) > 0).select(*keys, w.alias("_w"), F.posexplode(embedding).alias("_i", "_v"))
    sums = parts.groupBy(*keys, "_i").agg(F.sum(F.col("_v").cast("double") * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"))
    mean = F.col("s") / (F.col("w") + (1e-8 if weight else 0.0))
    packed = sums.select(*keys, "n", F.struct("_i", mean.alias("m")).alias("c")).groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("c")).alias("c"))
    return packed.select(*keys, "n", F.transform("c", lambda c: c["m"]).alias("mean"))


def spatial_centroids(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return rows.where(F.col(label) > 0).groupBy(*by, label).agg(*[F.avg(a).alias(f"c{a}") for a in "zyx"])


def value_range(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def dominant(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The commonest value of each group, the smallest of equals."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by(F.col(value), F.struct("n", -F.col(value))).alias(value))


def rank_percentiles(rows: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """sorted[floor(n * share)] of each group: exact, on counted distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counts, by, value, "n")
    out = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * s), F.col("total") - 1), F.col(value))).alias(f"p{round(s * 100):02d}") for s in shares]
    return placed.groupBy(*by).agg(*out)


def bounding_boxes(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return rows.where(F.col(label) > 0).groupBy(*by, label).agg(*[f(a).alias(f"{a}{n}") for a in "zyx" for f, n in ((F.min, "_min"), (F.max, "_max"))])


def top_checkpoints(log: DataFrame, metric: str, k: int, mode: str = "max") -> DataFrame:
    """The k best rows by a monitored metric."""
    return log.orderBy(F.desc(metric) if mode == "max" else F.asc(metric), "step").limit(k)


def metric_table(log: DataFrame, keys: list[str]) -> DataFrame:
    """(step, key, value) rows as one column a key."""
    return log.groupBy("step").pivot("key", keys).agg(F.first("value"))
