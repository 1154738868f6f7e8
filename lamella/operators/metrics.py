"""Segmentation metrics on sparse contingency tables. All are one aggregation of the voxels and small ones after it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators.selection import union_foreground


def contingency(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """(by, pred, gt, nij)."""
    return rows.groupBy(*by, F.col(pred).alias("pred"), F.col(gt).alias("gt")).agg(F.count(F.lit(1)).alias("nij"))


def with_marginals(table: DataFrame, by: list[str]) -> DataFrame:
    """The contingency with a (row sums by pred), b (by gt) and n: aggregations joined back, so no sample is one task's."""
    out = table
    for name, keys in (("a", [*by, "pred"]), ("b", [*by, "gt"])):
        side = table.groupBy(*keys).agg(F.sum("nij").alias(name)).withColumnsRenamed({k: f"_{k}" for k in keys})
        on = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"_{k}"))
            on = one if on is None else on & one
        out = out.join(side, on).drop(*[f"_{k}" for k in keys])
    total = table.groupBy(*by).agg(F.sum("nij").alias("n"))
    return out.join(total, by) if by else out.crossJoin(F.broadcast(total))  # one row


def _pairs(c):
    return c * (c - 1) / 2.0


def foreground_contingency(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    return contingency(union_foreground(rows, pred, gt), by, pred, gt)


def _samples(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.select(*by).distinct()


def _complete(rows: DataFrame, by: list[str], found: DataFrame) -> DataFrame:
    """A row for every sample: without foreground every metric is 0."""
    names = [c for c in found.columns if c not in by]
    return _samples(rows, by).join(found, by, "left").select(*by, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


def ari(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Adjusted Rand index, 0 at least; label 0 is a cluster among the rows kept; degenerate tables give 1."""
    c = foreground_contingency(rows, by, pred, gt)
    pairs = c.groupBy(*by).agg(F.sum(_pairs(F.col("nij"))).alias("ij"), F.sum("nij").alias("n"))
    sums = []
    for side, name in (("pred", "ra"), ("gt", "rb")):
        one = c.groupBy(*by, side).agg(F.sum("nij").alias("s"))
        sums.append(one.groupBy(*by).agg(F.sum(_pairs(F.col("s"))).alias(name)))
    t = pairs.join(sums[0], by).join(sums[1], by)
    expected = F.when(F.col("n") > 1, F.col("ra") * F.col("rb") / _pairs(F.col("n"))).otherwise(0.0)
    most = (F.col("ra") + F.col("rb")) / 2
    value = F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected))
    return _complete(rows, by, t.select(*by, F.greatest(value, F.lit(0.0)).alias("ari")))


#: Logarithms of small factorials; larger ones by Stirling's series, exact to rounding.
_SMALL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 256)))))
#: Terms of a hypergeometric sum that one row of work holds.
TERMS = 1 << 16


def log_factorial(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    y = np.maximum(x, 255.0)
    series = y * np.log(y) - y + 0.5 * np.log(2 * np.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return np.where(x < 256, _SMALL[np.minimum(x, 255).astype(np.int64)], series)


def expected_terms(x: int, y: int, n: int, first: int, stop: int) -> float:
    """The part from first to stop of the expected information of a pair of clusters of x and y of n elements."""
    k = np.arange(first, stop, dtype=np.float64)
    log_p = log_factorial(np.array([x, y, n - x, n - y])).sum() - log_factorial(np.array([n]))[0]
    log_p = log_p - log_factorial(k) - log_factorial(x - k) - log_factorial(y - k) - log_factorial(n - x - y + k)
    return float((k / n * np.log(n * k / (float(x) * y)) * np.exp(log_p)).sum())


def expected_information(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, emi) under the hypergeometric model, from cluster sizes a and b: (by, size, n).

    It depends on the distinct sizes and how often each occurs. The sum over the overlap k runs where the probability is
    above the least double (by Hoeffding's bound within sqrt(373 min) of the mean), in rows of TERMS terms.
    """

    @F.pandas_udf("double")
    def terms(x: pd.Series, y: pd.Series, n: pd.Series, first: pd.Series, stop: pd.Series) -> pd.Series:
        return pd.Series([expected_terms(*row) for row in zip(x.tolist(), y.tolist(), n.tolist(), first.tolist(), stop.tolist(), strict=True)], dtype=float)

    a = a.groupBy(*by, F.col("size").alias("x"), "n").agg(F.count(F.lit(1)).alias("tx"))
    b = b.groupBy(*by, F.col("size").alias("y")).agg(F.count(F.lit(1)).alias("ty"))
    pairs = a.join(b, by).repartition(*by, "x", "y")
    mean, wide = F.col("x") * F.col("y").cast("double") / F.col("n"), F.sqrt(373.0 * F.least("x", "y")) + 2
    low = F.greatest(F.lit(1).cast("long"), F.col("x") + F.col("y") - F.col("n"), F.floor(mean - wide))
    high = F.least(F.col("x"), F.col("y"), F.ceil(mean + wide))
    pairs = pairs.withColumns({"low": low, "high": high}).where("low <= high")
    parts = pairs.withColumn("first", F.explode(F.sequence("low", "high", F.lit(TERMS)))).withColumn("stop", F.least(F.col("first") + TERMS, F.col("high") + 1))
    value = terms("x", "y", "n", "first", "stop") * F.col("tx") * F.col("ty")
    return parts.select(*by, value.alias("v")).groupBy(*by).agg(F.sum("v").alias("emi"))


def ami(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Adjusted mutual information (arithmetic mean of entropies), 0 at least; one cluster on either side gives 1.

    Information and entropies are sums over the contingency and its margins; the expectation is expected_information.
    """
    c = foreground_contingency(rows, by, pred, gt)
    total = c.groupBy(*by).agg(F.sum("nij").alias("n"), F.sum(F.col("nij") * F.log("nij")).alias("both"))
    sizes = {name: c.groupBy(*by, of).agg(F.sum("nij").alias("size")).join(total.select(*by, "n"), by) for name, of in (("a", "pred"), ("b", "gt"))}
    out = total.join(expected_information(sizes["a"], sizes["b"], by), by, "left")
    for name, side in sizes.items():
        out = out.join(side.groupBy(*by).agg(F.sum(F.col("size") * F.log("size")).alias(f"s{name}"), F.count(F.lit(1)).alias(f"k{name}")), by)
    n, emi = F.col("n"), F.coalesce("emi", F.lit(0.0))
    entropy = {k: F.log(n) - F.col(f"s{k}") / n for k in "ab"}
    mi = F.log(n) + (F.col("both") - F.col("sa") - F.col("sb")) / n
    bottom = (entropy["a"] + entropy["b"]) / 2 - emi
    bottom = F.when(bottom < 0, F.least(bottom, F.lit(-2.220446049250313e-16))).otherwise(F.greatest(bottom, F.lit(2.220446049250313e-16)))
    score = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (mi - emi) / bottom))
    return _complete(rows, by, out.select(*by, score.alias("ami")))


def axi(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    both = ari(rows, by, pred, gt).join(ami(rows, by, pred, gt), by)
    return both.withColumn("axi", F.sqrt(F.col("ari") * F.col("ami")))


def voi(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Variation of information in bits: voi_split is H(gt | pred), voi_merge is H(pred | gt), voi_total their sum."""
    t = with_marginals(foreground_contingency(rows, by, pred, gt), by)
    p = F.col("nij") / F.col("n")
    split, merge = -F.sum(p * F.log2(F.col("nij") / F.col("a"))), -F.sum(p * F.log2(F.col("nij") / F.col("b")))
    found = t.groupBy(*by).agg((split + 0.0).alias("voi_split"), (merge + 0.0).alias("voi_merge"))
    return _complete(rows, by, found.withColumn("voi_total", F.col("voi_split") + F.col("voi_merge")))


def ted(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    """Splits and merges to repair: partners beyond the first of each gt and of each pred, label 0 included."""
    c = foreground_contingency(rows, by, pred, gt)
    parts = []
    for side in ("gt", "pred"):
        one = c.groupBy(*by, side).agg(F.count(F.lit(1)).alias("k"))
        parts.append(one.groupBy(*by).agg(F.sum(F.greatest(F.col("k") - 1, F.lit(0))).cast("double").alias(f"ted_{side}")))
    return _complete(rows, by, parts[0].join(parts[1], by).withColumn("ted", F.col("ted_gt") + F.col("ted_pred")).select(*by, "ted"))


def _per_class(rows: DataFrame, by: list[str], classes: int, pred: str, gt: str, ignore: int | None) -> DataFrame:
    kept = rows.where(F.col(gt) != ignore) if ignore is not None else rows
    c = contingency(kept, by, pred, gt)
    pairs = c.select(*by, F.col("pred").alias("class_id"), F.col("nij").alias("p"), F.lit(0).alias("t"), F.when(F.col("pred") == F.col("gt"), F.col("nij")).otherwise(0).alias("i"))
    pairs = pairs.unionAll(c.select(*by, F.col("gt").alias("class_id"), F.lit(0).alias("p"), F.col("nij").alias("t"), F.lit(0).alias("i")))
    return pairs.where(f"class_id >= 0 and class_id < {classes}").groupBy(*by, "class_id").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("i").alias("i"))


def dice_per_class(rows: DataFrame, by: list[str], classes: int, pred: str = "pred", gt: str = "gt", ignore: int | None = None, eps: float = 1e-7) -> DataFrame:
    """Classes that prediction or target has."""
    t = _per_class(rows, by, classes, pred, gt, ignore)
    return t.select(*by, "class_id", ((2 * F.col("i") + eps) / (F.col("p") + F.col("t") + eps)).alias("dice"))


def iou_per_class(rows: DataFrame, by: list[str], classes: int, pred: str = "pred", gt: str = "gt", ignore: int | None = None, eps: float = 1e-7) -> DataFrame:
    t = _per_class(rows, by, classes, pred, gt, ignore)
    return t.select(*by, "class_id", ((F.col("i") + eps) / (F.col("p") + F.col("t") - F.col("i") + eps)).alias("iou"))


def mean_dice(rows: DataFrame, by: list[str], classes: int, pred: str = "pred", gt: str = "gt", ignore: int | None = None) -> DataFrame:
    return _complete(rows, by, dice_per_class(rows, by, classes, pred, gt, ignore).groupBy(*by).agg(F.avg("dice").alias("dice")))


def mean_iou(rows: DataFrame, by: list[str], classes: int, pred: str = "pred", gt: str = "gt", ignore: int | None = None) -> DataFrame:
    return _complete(rows, by, iou_per_class(rows, by, classes, pred, gt, ignore).groupBy(*by).agg(F.avg("iou").alias("iou")))


def pixel_accuracy(rows: DataFrame, by: list[str], pred: str = "pred", gt: str = "gt") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg((F.col(pred) == F.col(gt)).cast("double")).alias("accuracy"))


def batch_mean(values: DataFrame, positive: list[str], every: list[str]) -> DataFrame:
    """Batch averages: metrics in `positive` over the samples above 0 (0 if none), those in `every` over all."""
    means = [F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)).alias(c) for c in positive]
    return values.agg(*means, *[F.avg(c).alias(c) for c in every])


def evaluation(rows: DataFrame, by: list[str], classes: int = 3, pred: str = "pred", gt: str = "gt", sem_pred: str = "cls", sem_gt: str = "cls_gt", semantic_ari: bool = True) -> DataFrame:
    """The validation bundle of a sample: semantic accuracy, IoU and ARI, instance ARI, AMI, VOI and TED."""
    out = pixel_accuracy(rows, by, sem_pred, sem_gt).withColumnRenamed("accuracy", "sem_acc")
    out = out.join(mean_iou(rows, by, classes, sem_pred, sem_gt).withColumnRenamed("iou", "sem_iou"), by)
    if semantic_ari:
        out = out.join(ari(rows, by, sem_pred, sem_gt).withColumnRenamed("ari", "sem_ari"), by)
    return out.join(ari(rows, by, pred, gt), by).join(ami(rows, by, pred, gt), by).join(voi(rows, by, pred, gt), by).join(ted(rows, by, pred, gt), by)
