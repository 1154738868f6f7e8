"""Loss values as aggregations: embeddings, semantics, instances, geometry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np
import pandas as pd

from lamella.functions.scalar import cosine, hinge_pull, hinge_push, lp_distance, norm, regression_kernel, sigmoid
from lamella.operators import meanshift
from lamella.operators.aggregates import instance_means
from lamella.operators.stencil import linear_lookup
from lamella.session import cut

#: Instances of a sample up to which all of them are packed into one row.
PACKED = 512


def _pairs_within(means: DataFrame, by: list[str]) -> DataFrame:
    """Distances of the means of a sample's instances, i < j. A sample's instances are packed into one array."""
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("m"))
    place = F.sequence(F.lit(0), F.size("m") - 1)
    return packed.withColumn("i", F.explode(place)).select(
        *by, F.explode(F.transform(F.filter(place, lambda j: j > F.col("i")), lambda j: lp_distance(F.col("m")[F.col("i")]["mean"], F.col("m")[j]["mean"]))).alias("d")
    )


def push_term(means: DataFrame, by: list[str], margin: float, name: str = "push", packed: int = PACKED) -> DataFrame:
    """(by, name): mean over a sample's pairs of instances of max(2 * margin - distance, 0) ** 2, for samples with a pair.

    The hinge is zero beyond twice the margin. Where a sample has more than `packed` instances, means meet only those in
    the grid cells within that range; each one gets the sum over the others there, so no pair is ever a row.
    """
    means = cut(means.select(*by, "label", "mean"))
    counts = means.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    most, total = counts.agg(F.max("_k"), F.sum("_k")).first()
    if (most or 0) <= packed:
        return _pairs_within(means, by).groupBy(*by).agg(F.avg(hinge_push(F.col("d"), margin)).alias(name))
    vectors, reach = meanshift.Vectors(means, by, "mean"), 2.0 * margin

    def sums(x: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        m, out = meanshift._matrix(own["x"]), np.zeros(len(own))
        n = meanshift._step(x.size)
        for a in range(0, len(m), n):
            out[a : a + n] = (np.maximum(reach - np.sqrt(meanshift._squared(x, m[a : a + n])), 0) ** 2).sum(0)
        return own[by].assign(_s=out)

    modes = means.select(*by, F.monotonically_increasing_id().alias("mode"), F.col("mean").cast("array<double>").alias("x"))
    near = meanshift.met(vectors, modes, total, reach, sums, f"{vectors.of_by}_s double").groupBy(*by).agg(F.sum("_s").alias("_s"))
    pairs = F.col("_k") * (F.col("_k") - 1)
    # every mean has met itself, at distance zero
    return counts.where("_k > 1").join(near, by).select(*by, ((F.col("_s") - F.col("_k") * reach * reach) / pairs).alias(name))


def centroid_embedding_loss(rows: DataFrame, by: list[str], delta_pull: float = 0.5, delta_push: float = 1.5, weights: tuple[float, float, float] = (1.0, 1.0, 0.001), p: int = 2, embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(by, l_pull, l_push, l_reg, loss) of the samples that have instances."""
    rows = rows.withColumnRenamed(label, "label") if label != "label" else rows
    means = instance_means(rows, embedding, "label", by)
    gaps = rows.where("label > 0").join(means, [*by, "label"]).select(*by, "label", hinge_pull(lp_distance(F.col(embedding), F.col("mean"), p), delta_pull).alias("h"))
    pull = gaps.groupBy(*by, "label").agg(F.avg("h").alias("h")).groupBy(*by).agg(F.avg("h").alias("l_pull"))
    push = push_term(means, by, delta_push, "l_push")
    reg = means.groupBy(*by).agg(F.avg(norm(F.col("mean"))).alias("l_reg"))
    out = pull.join(reg, by).join(push, by, "left").withColumn("l_push", F.coalesce("l_push", F.lit(0.0)))
    a, b, c = weights
    return out.select(*by, "l_pull", "l_push", "l_reg", (a * F.col("l_pull") + b * F.col("l_push") + c * F.col("l_reg")).alias("loss"))


def batch_loss(values: DataFrame, names: list[str]) -> DataFrame:
    """Averages over samples; 0 without any."""
    return values.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names])


def semantic_loss(rows: DataFrame, by: list[str], classes: int, logits: str = "logits", target: str = "target", mode: str = "sigmoid", eps: float = 1e-5, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(by, ce, iou, dice, loss): cross-entropy (binary for sigmoid), soft IoU and soft Dice losses over the classes, and
    their weighted sum.

    Rows whose target is negative are left out.
    """
    kept = rows.where(F.col(target) >= 0)
    z = F.col(logits)
    if mode == "sigmoid":
        probs = F.transform(z, sigmoid)
    else:
        top = F.array_max(z)
        total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        probs = F.transform(z, lambda v: F.exp(v - top) / total)
    cells = kept.select(*by, F.posexplode(F.arrays_zip(probs.alias("p"), z.alias("z"))).alias("c", "v"), F.col(target).alias("t"))
    cells = cells.select(*by, "c", F.col("v.p").alias("p"), F.col("v.z").alias("z"), (F.col("t") == F.col("c")).cast("double").alias("y"))
    if mode == "sigmoid":
        ce = F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z")))
    else:
        ce = F.when(F.col("y") == 1, -F.log(F.greatest("p", F.lit(1e-30)))).otherwise(0.0)
    sums = cells.groupBy(*by, "c").agg(F.sum(ce).alias("ce"), F.sum(F.col("p") * F.col("y")).alias("i"), F.sum("p").alias("p"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    scale = F.count(F.lit(1)) if mode == "sigmoid" else F.lit(1)
    iou = 1 - F.avg((F.col("i") + eps) / (F.col("p") + F.col("y") - F.col("i") + eps))
    dice = 1 - F.avg((2 * F.col("i") + eps) / (F.col("p") + F.col("y") + eps))
    out = sums.where(f"c < {classes}").groupBy(*by).agg((F.sum("ce") / F.max("n") / scale).alias("ce"), iou.alias("iou"), dice.alias("dice"))
    return out.withColumn("loss", reduce(lambda a, b: a + b, [w * F.col(n) for w, n in zip(weights, ("ce", "iou", "dice"), strict=True)]))


def instance_loss(rows: DataFrame, by: list[str], delta_pull: float = 0.5, delta_push: float = 1.5, embedding: str = "embedding", weight: str = "weight", weights: tuple[float, float, float] = (1.0, 1.0, 0.001)) -> DataFrame:
    """(by, pull, push, norm, loss): weighted instance centres, mean weighted pull, push between centres, mean centre norm,
    and their weighted sum, for the samples that have instances."""
    means = cut(instance_means(rows, embedding, "label", by, weight))
    gaps = rows.where("label > 0").join(means, [*by, "label"]).select(*by, "label", F.col(weight).alias("w"), hinge_pull(lp_distance(F.col(embedding), F.col("mean")), delta_pull).alias("h"))
    pull = gaps.groupBy(*by, "label").agg(F.avg(F.col("h") * F.col("w")).alias("h")).groupBy(*by).agg(F.avg("h").alias("pull"))
    size = means.groupBy(*by).agg(F.avg(norm(F.col("mean"))).alias("norm"))
    out = pull.join(size, by).join(push_term(means, by, delta_push), by, "left").select(*by, "pull", F.coalesce("push", F.lit(0.0)).alias("push"), "norm")
    return out.withColumn("loss", reduce(lambda a, b: a + b, [w * F.col(n) for w, n in zip(weights, ("pull", "push", "norm"), strict=True)]))


def instance_loss_by_class(rows: DataFrame, by: list[str], cls: str = "class_id", **options) -> DataFrame:
    """One row (pull, push, norm, loss): for each class above 0 the average over its samples with instances, then over the
    classes that occur; a class without instances counts as zero. All classes are computed together."""
    names = ["pull", "push", "norm", "loss"]
    of_class = rows.where(F.col(cls) > 0)
    losses = instance_loss(of_class, [*by, cls], **options).groupBy(cls).agg(*[F.avg(n).alias(n) for n in names])
    present = of_class.select(cls).distinct().join(losses, cls, "left")
    return present.agg(*[F.coalesce(F.avg(F.coalesce(n, F.lit(0.0))), F.lit(0.0)).alias(n) for n in names])


def skeleton_embedding_loss(rows: DataFrame, by: list[str], delta: float = 20.0, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 5.0), field: DataFrame | None = None, value: str = "dt_norm", axes: str = "yx", key: str = "lin") -> DataFrame:
    """rows: voxels with label, place, o<axis> (offset), n<axis> (skeleton voxel), g<axis> (gradient of the distance).

    pull: squared distance from where the offset lands to the skeleton; penalty: 1 - cosine of offset and gradient;
    benefit: 1 - the normalised distance where it lands, taken linearly from `field` (by, places, value; zero where it has
    no row), or from a column dt_at of rows; push between the instances' mean landing places.
    """
    fg = rows.where("label > 0").withColumns({f"p{a}": F.col(a) + F.col(f"o{a}") for a in axes})
    pull = reduce(lambda a, b: a + b, [F.pow(F.col(f"p{a}") - F.col(f"n{a}"), 2) for a in axes])
    penalty = 1 - cosine(F.array(*[f"o{a}" for a in axes]), F.array(*[f"g{a}" for a in axes]), 1e-5)
    own = [F.avg(pull).alias("pull"), F.avg(penalty).alias("penalty")]
    if field is None:
        per = fg.groupBy(*by).agg(*own, F.avg(1 - F.col("dt_at")).alias("benefit"))
    else:  # the samples are averaged for themselves; voxels need not meet them again
        landed = fg.select(*by, F.col(key).alias("id"), *[f"p{a}" for a in axes])
        benefit = linear_lookup(landed, field, by, value, axes).groupBy(*by).agg(F.avg(1 - F.col(value)).alias("benefit"))
        per = fg.groupBy(*by).agg(*own).join(benefit, by)
    means = fg.groupBy(*by, "label").agg(F.array(*[F.avg(f"p{a}") for a in axes]).alias("mean"))
    out = per.join(push_term(means, by, delta / 2), by, "left").withColumn("push", F.coalesce("push", F.lit(0.0)))
    a, b, c, d = weights
    return out.withColumn("loss", a * F.col("pull") + b * F.col("push") + c * F.col("penalty") + d * F.col("benefit"))


def geometry_loss(rows: DataFrame, by: list[str], terms: dict[str, tuple[list[str], list[str], str, float]]) -> DataFrame:
    """Foreground means of regression terms: name -> (predicted columns, target columns, kernel, weight); and their weighted sum."""
    fg = rows.where("label > 0")
    values = {}
    for name, (pred, target, kernel, _) in terms.items():
        parts = [regression_kernel(kernel, F.col(p) - F.col(t)) for p, t in zip(pred, target, strict=True)]
        values[name] = F.avg(reduce(lambda a, b: a + b, parts) / len(parts))
    out = fg.groupBy(*by).agg(*[v.alias(n) for n, v in values.items()])
    return out.withColumn("loss", reduce(lambda a, b: a + b, [F.col(n) * t[3] for n, t in terms.items()]))


def composite(parts: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(by, key, value) rows with slash paths from several loss tables."""
    out = None
    for prefix, rows in parts.items():
        for name in [c for c in rows.columns if c not in by]:
            one = rows.select(*by, F.lit(f"{prefix}/{name}").alias("key"), F.col(name).cast("double").alias("value"))
            out = one if out is None else out.unionByName(one)
    return out


def combined_loss(semantic: DataFrame, instance: DataFrame, by: list[str], geometry: DataFrame | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 0.0)) -> DataFrame:
    """(by, key, value): each branch's loss and parts (loss_sem, loss_sem/ce, ...) and the weighted total `loss`.

    Each branch is a table (by, loss, parts...). A sample without instances has zeros there; the geometry branch counts
    where it is given and weighs more than 0.
    """
    branches = {"loss_sem": (semantic, weights[0]), "loss_ins": (instance, weights[1])}
    if geometry is not None and weights[2] > 0:
        branches["loss_geom"] = (geometry, weights[2])
    out, total, keys = None, F.lit(0.0), []
    for prefix, (rows, weight) in branches.items():
        parts = [c for c in rows.columns if c not in by]
        named = rows.select(*by, *[F.col(c).cast("double").alias(prefix if c == "loss" else f"{prefix}/{c}") for c in parts])
        out = named if out is None else out.join(named, by, "left")
        keys += named.columns[len(by) :]
        total = total + weight * F.coalesce(F.col(prefix), F.lit(0.0))
    out = out.withColumn("loss", total)
    return out.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias("value")) for k in [*keys, "loss"]])).alias("_c")).select(*by, "_c.key", "_c.value")
