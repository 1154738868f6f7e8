"""Point prompts: sampling, sparse indicator volumes, disk splats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.operators.aggregates import dominant

AXES = ["z", "y", "x"]


def sample_points(rows: DataFrame, by: list[str], n_pos: int = 5, n_neg: int = 5, mode: str = "instance", seed: int = 0, label: str = "label", semantic: str = "cls", key: str = "lin") -> DataFrame:
    """(by, polarity, ord, z, y, x, target_sem, target_inst): points in and out of a target chosen for each sample.

    The target is the instance (or class) with the smallest hash of the seed; the points are the voxels with the
    smallest hashes, again from the first if there are too few. Only n candidates a sample and polarity leave a
    task. Samples without foreground give no rows.
    """
    ident = label if mode == "instance" else semantic
    options = rows.where(F.col(ident) > 0).select(*by, ident).distinct()
    target = options.groupBy(*by).agg(F.min_by(ident, F.struct(F.xxhash64(F.lit(seed), ident), F.col(ident))).alias("target"))
    joined = rows.join(target, by).withColumn("polarity", F.when(F.col(ident) == F.col("target"), "pos").otherwise("neg"))
    if mode == "instance":
        sem = dominant(joined.where("polarity = 'pos'"), by, semantic).withColumnRenamed(semantic, "target_sem")
        joined = joined.join(sem, by).withColumn("target_inst", F.col("target").cast("long"))
    else:
        joined = joined.withColumns({"target_sem": F.col("target"), "target_inst": F.lit(0).cast("long")})
    w = Window.partitionBy(*by, "polarity").orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    n = F.when(F.col("polarity") == "pos", n_pos).otherwise(n_neg)
    top = joined.withColumn("_r", F.row_number().over(w) - 1).where(F.col("_r") < n)
    held = top.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*by, "polarity")))
    filled = held.withColumn("ord", F.explode(F.filter(F.sequence(F.lit(0), n - 1), lambda o: F.pmod(o, F.col("_k")) == F.col("_r"))))
    return filled.select(*by, "polarity", F.col("ord").cast("int").alias("ord"), *AXES, F.col("target_sem").cast("int").alias("target_sem"), "target_inst")


def indicator_volume(points: DataFrame, by: list[str], classes: int) -> DataFrame:
    """Sparse (by, channel, z, y, x, value): 0 positives, 1 negatives, 2.. the class one-hot at both, last the instance mask."""
    channels = F.array(
        F.when(F.col("polarity") == "pos", 0).otherwise(1),
        F.when((F.col("target_sem") >= 0) & (F.col("target_sem") < classes), F.col("target_sem") + 2),
        F.when((F.col("polarity") == "pos") & (F.col("target_inst") > 0), F.lit(classes + 2)),
    )
    out = points.withColumn("channel", F.explode(F.filter(channels, lambda c: c.isNotNull())))
    return out.select(*by, F.col("channel").cast("int").alias("channel"), *AXES).distinct().withColumn("value", F.lit(1.0))


def splat(points: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels of a disk around each point, cut at the image."""
    disk = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk])
    keep = [c for c in points.columns if c not in ("y", "x")]
    out = points.withColumn("o", F.explode(offsets)).select(*keep, (F.col("y") + F.col("o.dy")).cast("int").alias("y"), (F.col("x") + F.col("o.dx")).cast("int").alias("x"))
    return out.where(f"y >= 0 and y < {height} and x >= 0 and x < {width}").distinct()
