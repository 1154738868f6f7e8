"""Embedding clusters: soft mean shift, flat-kernel mean shift, Hough votes, nearest modes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalar import lp_distance
from lamella.operators import meanshift
from lamella.operators.geometry import nearest_sites
from lamella.operators.relabel import drop_small, relabel_sequential
from lamella.plans.rank import numbered_within
from lamella.session import cut


def assign_modes(rows: DataFrame, modes: np.ndarray, bandwidth: float, temperature: float, embedding: str = "embedding") -> DataFrame:
    """cluster (from 1) and its softmax share: the modes are a bounded literal, so this is one pass without shuffle."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in modes])
    logits = F.transform(table, lambda m: -F.pow(lp_distance(F.col(embedding).cast("array<double>"), m), 2) / (2 * bandwidth**2 * temperature))
    rows = rows.withColumn("_l", logits).withColumn("_m", F.array_max("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("_m")))
    return rows.withColumns({"cluster": F.array_position("_l", F.col("_m")).cast("long"), "share": 1 / total}).drop("_l", "_m")


def soft_mean_shift(rows: DataFrame, bandwidth: float = 0.5, iterations: int = 10, temperature: float = 1.0, least: int = 50, max_seeds: int = 256, seed: int = 0, key: str = "lin", embedding: str = "embedding", foreground: str | None = None, by: list[str] | None = None) -> tuple[DataFrame, pd.DataFrame]:
    """(rows with cluster and share, modes): each group (by) for itself, all in the same passes.

    Background gets 0; clusters under `least` rows too, ids stay as they are.
    """
    by = by or []
    fg = rows.where(foreground) if foreground else rows
    modes = meanshift.soft_modes(fg, by, bandwidth, iterations, max_seeds, seed, key, embedding, meanshift.HELD)
    out = meanshift.soft_assigned(rows, modes, by, bandwidth, temperature, embedding)
    if foreground:
        out = out.withColumns({c: F.when(F.expr(foreground), F.col(c)).otherwise(F.lit(0)) for c in ("cluster", "share")})
    return drop_small(out.withColumn("cluster", F.col("cluster").cast("long")), least, "cluster", by), modes


def mean_shift(rows: DataFrame, bandwidth: float = 0.5, least: int = 50, iterations: int = 300, embedding: str = "embedding", foreground: str | None = None, by: list[str] | None = None, held: int | None = None) -> DataFrame:
    """Flat-kernel mean shift from binned seeds (meanshift.flat_clusters); rows get cluster, small clusters 0, the rest
    compact ids within their group."""
    fg = rows.where(foreground) if foreground else rows
    out = meanshift.flat_clusters(fg, bandwidth, by, iterations, embedding, held)
    if foreground:
        out = out.unionByName(rows.where(~F.coalesce(F.expr(foreground), F.lit(False))).withColumn("cluster", F.lit(0).cast("long")))
    return drop_small(out, least, "cluster", by, compact=True)


def per_class_clusters(rows: DataFrame, cls: str = "class_id", classes: list[int] | None = None, name: str = "final_id", **options) -> DataFrame:
    """Instances of every class above 0 (or of the given ones): soft mean shift within each class, all classes in one run
    of passes; ids count from 1 by class, then by cluster. Other rows get 0."""
    wanted = f"{cls} > 0" if classes is None else f"{cls} in ({', '.join(map(str, classes))})"
    got, _ = soft_mean_shift(rows, foreground=wanted, by=[cls], **options)
    return per_class_ids(got, cls, "cluster").withColumnRenamed("final_id", name).drop("share")


def nearest_centres(rows: DataFrame, centres: DataFrame, by: list[str] | None = None, embedding: str = "embedding", name: str = "nearest", held: int | None = None) -> DataFrame:
    """rows with the label of the nearest centre (by, label, mean) of their group and the distance `<name>_d`; the smaller
    label of equals, null for a group without centres or a null vector.

    Centres up to meanshift.HELD numbers (checked) go along with one pass; more are met in grid cells of growing size.
    """
    by = by or []
    modes = cut(centres.select(*by, F.col("label").cast("long").alias("cluster"), F.col("mean").cast("array<double>").alias("x")).where("x is not null"))
    size, spread = modes.agg(F.sum(F.size("x")), F.avg(F.aggregate("x", F.lit(0.0), lambda s, v: s + F.abs(v)))).first()
    few = (size or 0) <= (meanshift.HELD if held is None else held)
    got = meanshift.nearest_modes(rows, modes.toPandas().sort_values("cluster") if few else modes, by, max(spread or 1.0, 1e-9) / 8, embedding, None)
    found = modes.select(*by, F.col("cluster").alias("_c"), F.col("x").alias("_x")).withColumnsRenamed({b: f"_{b}" for b in by})
    on = F.col("cluster") == F.col("_c")
    for b in by:
        on = on & (F.col(b) == F.col(f"_{b}"))
    out = got.join(found, on, "left").withColumn(f"{name}_d", lp_distance(F.col(embedding).cast("array<double>"), F.col("_x")))
    return out.withColumnRenamed("cluster", name).drop("_c", "_x", *[f"_{b}" for b in by])


def hough_votes(rows: DataFrame, by: list[str], bin_size: float = 2.0, axes: str = "yx", mode: str = "count") -> DataFrame:
    """(by, b<axis>, votes): votes at place plus offset o<axis>, binned half to even; 'occupancy' counts a bin once."""
    bins = [F.rint((F.col(a) + F.col(f"o{a}")) / bin_size).cast("int").alias(f"b{a}") for a in axes]
    n = F.count(F.lit(1)) if mode == "count" else F.lit(1)
    return rows.select(*by, *bins).groupBy(*by, *[f"b{a}" for a in axes]).agg(F.max(n).alias("votes") if mode != "count" else n.alias("votes"))


def hough_labels(rows: DataFrame, by: list[str], bin_size: float = 2.0, sigma: float = 2.0, threshold: float = 0.3, min_votes: float = 50, axes: str = "yx", mode: str = "count") -> DataFrame:
    """label: 1 + the order of the nearest peak of the smoothed votes; 0 without peaks. rows are the foreground.

    Votes are smoothed by a box of 2 * int(3 sigma) + 1 bins within the range of the group's bins; every bin that reaches
    the threshold (a share of the highest, and min_votes) is a peak. Peaks count in the order of x, then y(, then z); of
    equally near ones the first counts. Sparse throughout: a vote spreads to the bins of its box one axis after another, and
    the nearest peak of each occupied bin is looked for in blocks around it, farther and farther.
    """
    names, order = [f"b{a}" for a in axes], axes[::-1]
    binned = rows.withColumns({f"b{a}": F.rint((F.col(a) + F.col(f"o{a}")) / bin_size).cast("int") for a in axes})
    votes = cut(hough_votes(rows, by, bin_size, axes, mode))
    ends = votes.groupBy(*by).agg(*[f(n).alias(f"{n}_{k}") for n in names for f, k in ((F.min, "lo"), (F.max, "hi"))])
    radius = int(3 * sigma)
    smooth = votes.join(ends, by) if by else votes.crossJoin(F.broadcast(ends))  # one row
    for n in names if radius else ():
        near = F.sequence(F.greatest(F.col(n) - radius, f"{n}_lo"), F.least(F.col(n) + radius, f"{n}_hi"))
        bounds = [f"{m}_{k}" for m in names for k in ("lo", "hi")]
        smooth = smooth.withColumn("_n", F.explode(near)).drop(n).withColumnRenamed("_n", n).groupBy(*by, *names, *bounds).agg(F.sum("votes").alias("votes"))
    smooth = cut(smooth.select(*by, *names, *[(F.col(f"b{a}") - F.col(f"b{a}_lo")).alias(f"_s{a}") for a in axes], (F.col("votes") / F.lit(float((2 * radius + 1) ** len(axes)))).alias("smooth")))
    top = smooth.groupBy(*by).agg(F.max("smooth").alias("_m"))
    peaks = smooth.join(top, by) if by else smooth.crossJoin(F.broadcast(top))  # one row
    peaks = peaks.where((F.col("smooth") >= F.greatest(F.col("_m") * threshold, F.lit(float(min_votes)))) & (F.col("smooth") > 0))
    peaks = cut(numbered_within(peaks.select(*by, *[f"_s{a}" for a in axes]), by, [f"_s{a}" for a in order], "_id"))
    # places among bins, counted from the group's first ones
    sites = peaks.select(*by, *[F.col(f"_s{a}").alias(a) for a in axes], F.lit(1).alias("_l"))
    bins = votes.join(ends, by) if by else votes.crossJoin(F.broadcast(ends))  # one row
    bins = bins.select(*by, *names, *[(F.col(f"b{a}") - F.col(f"b{a}_lo")).alias(a) for a in axes], F.lit(1).alias("_l"))
    some = sites.select(*by, "_l").distinct()
    near = nearest_sites(bins.join(some, [*by, "_l"], "left_semi"), sites, by, "_l", order)
    near = near.select(*by, *names, *[F.col(f"n{a}").cast("int").alias(f"_s{a}") for a in axes]).join(peaks, [*by, *[f"_s{a}" for a in axes]])
    got = binned.drop("label").join(near.select(*by, *names, (F.col("_id") + 1).alias("label")), [*by, *names], "left")
    return got.withColumn("label", F.coalesce("label", F.lit(0)).cast("long")).drop(*names)


def per_class_ids(rows: DataFrame, cls: str = "class_id", cluster: str = "cluster") -> DataFrame:
    from lamella.operators.relabel import final_ids

    return final_ids(rows, cls, cluster)


def compact(rows: DataFrame, label: str = "cluster") -> DataFrame:
    return relabel_sequential(rows, label)
