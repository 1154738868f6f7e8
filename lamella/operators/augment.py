"""Seeded augmentation: random transforms of each sample whose draws are columns, computed from a seed and the sample.

A draw is a hash of the seed, the step's number and name, and the sample's columns (for noise also the voxel's place), so the
same seed gives the same rows at any partitioning. Steps work on voxel rows (by, z, y, x, intensity, labels ...).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.operators import lines, stencil
from lamella.operators.geometry import gaussian_filter


def uniform(seed: int, name: str, *keys: str) -> Column:
    """A number in [0, 1) for each value of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def normal(seed: int, name: str, *keys: str) -> Column:
    """A standard normal number for each value of the keys, of two uniform ones."""
    u, v = uniform(seed, name + "/u", *keys), uniform(seed, name + "/v", *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def smooth_pass(axis: str, size: int, sigma: float, name: str):
    """Gaussian filter (cut off at four sigma, reflecting at the ends) along lines that have all their places."""

    def fn(table: pa.Table, first: np.ndarray) -> dict[str, np.ndarray]:
        return {name: gaussian_filter(table[name].to_numpy().reshape(-1, size), sigma, (None, 0)).ravel()}

    return fn


def displacement_field(samples: DataFrame, by: list[str], shape: tuple[int, int], sigma: float = 10.0, alpha: float = 100.0, seed: int = 0) -> DataFrame:
    """(by, y, x, dy, dx) for every place of each sample's section: noise from -1 to 1, smoothed along each axis, times alpha."""
    h, w = shape
    out = samples.select(*by).distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    for name in ("dy", "dx"):
        out = out.withColumn(name, 2.0 * uniform(seed, f"elastic/{name}", *by, "y", "x") - 1.0)
    for axis, other, size in (("y", "x", h), ("x", "y", w)):
        passes = [smooth_pass(axis, size, sigma, name) for name in ("dy", "dx")]
        out = lines.along(out, [*by, other], axis, lambda t, first, passes=passes: passes[0](t, first) | passes[1](t, first), "dy double, dx double")
    return out.withColumns({name: F.col(name) * alpha for name in ("dy", "dx")})


def elastic(rows: DataFrame, by: list[str], shape: tuple[int, int], columns: list[str], sigma: float = 10.0, alpha: float = 100.0, prob: float = 0.5, seed: int = 0) -> DataFrame:
    """(by, y, x, columns): sections warped by a random field, each sample with probability prob, by one field for all of its
    sections; the source is clipped to the section, then truncated to a voxel."""
    h, w = shape
    keys = list(dict.fromkeys([*by, *(["z"] if "z" in rows.columns and "z" not in by else []), "y", "x"]))
    rows = rows.select(*dict.fromkeys([*keys, *columns]))
    chosen = uniform(seed, "elastic", *by) < prob
    moved = displacement_field(rows.where(chosen), by, shape, sigma, alpha, seed)
    clipped = {a: F.least(F.greatest(F.col(a) + F.col(f"d{a}"), F.lit(0.0)), F.lit(n - 1.0)).cast("int") for a, n in (("y", h), ("x", w))}
    moved = moved.select(*by, F.col("y").alias("_ty"), F.col("x").alias("_tx"), clipped["y"].alias("y"), clipped["x"].alias("x"))
    warped = rows.join(moved, [*by, "y", "x"]).drop("y", "x").withColumnsRenamed({"_ty": "y", "_tx": "x"})
    return rows.where(~chosen).unionByName(warped.select(*[F.col(c).cast(t).alias(c) for c, t in rows.dtypes]))


def resize_linear(rows: DataFrame, by: list[str], shape: dict[str, int], size: dict[str, int], value: str = "intensity") -> DataFrame:
    """(by, places, value) of sections of another size, linear along each axis: place t looks at (t + 0.5) * old / new - 0.5.

    Each voxel goes to the places that it has a share in, a range of numbers for each axis.
    """
    out = rows.withColumn("_w", F.lit(1.0))
    for a, new in size.items():
        old = shape[a]
        at = F.col(a)
        low = F.greatest(F.lit(0), F.floor((at - 0.5) * new / old - 0.5)).cast("int")
        high = F.least(F.lit(new - 1), F.ceil((at + 1.5) * new / old - 0.5)).cast("int")
        low, high = F.when(at == 0, F.lit(0)).otherwise(low), F.when(at == old - 1, F.lit(new - 1)).otherwise(high)
        out = out.withColumn("_t", F.explode(F.sequence(low, high)))
        source = F.least(F.greatest((F.col("_t") + 0.5) * old / new - 0.5, F.lit(0.0)), F.lit(old - 1.0))
        out = out.withColumn("_w", F.col("_w") * F.greatest(F.lit(0.0), 1.0 - F.abs(source - at))).where("_w > 0").withColumn(a, F.col("_t")).drop("_t")
    rest = [a for a in ("z", "y", "x") if a in rows.columns and a not in by]
    return out.groupBy(*by, *rest).agg(F.sum(F.col(value) * F.col("_w")).alias(value))


@dataclass
class Chain:
    """A chain of random transforms: each method adds a step; apply() runs them in order.

    Chain(by, {"y": 100, "x": 50}, seed=7).flip("y").flip("x").rot90().noise().contrast().apply(rows)
    """

    by: list[str]
    shape: dict[str, int]
    seed: int = 0
    value: str = "intensity"
    steps: list = field(default_factory=list)

    def _chosen(self, k: int, prob: float) -> Column:
        return uniform(self.seed, f"{k}/on", *self.by) < prob

    def flip(self, axis: str, prob: float = 0.5) -> Chain:
        """The axis reversed; of a section that a quarter turn has turned, its present length counts."""
        self.steps.append(lambda rows, k: rows.withColumn(axis, F.when(self._chosen(k, prob), F.col(f"_n{axis}") - 1 - F.col(axis)).otherwise(F.col(axis)).cast("int")))
        return self

    def rot90(self, prob: float = 0.5, most: int = 3) -> Chain:
        """One to `most` quarter turns in the plane, from y towards x: each takes (y, x) to (width - 1 - x, y)."""

        def step(rows: DataFrame, k: int) -> DataFrame:
            turns = F.when(self._chosen(k, prob), 1 + F.floor(uniform(self.seed, f"{k}/turns", *self.by) * most)).otherwise(0)
            rows = rows.withColumn("_k", turns)
            y, x, h, w = (F.col(c) for c in ("y", "x", "_ny", "_nx"))
            new_y = F.when(F.col("_k") == 1, w - 1 - x).when(F.col("_k") == 2, h - 1 - y).when(F.col("_k") == 3, x).otherwise(y)
            new_x = F.when(F.col("_k") == 1, y).when(F.col("_k") == 2, w - 1 - x).when(F.col("_k") == 3, h - 1 - y).otherwise(x)
            odd = F.col("_k") % 2 == 1
            return rows.withColumns({"y": new_y.cast("int"), "x": new_x.cast("int"), "_ny": F.when(odd, w).otherwise(h), "_nx": F.when(odd, h).otherwise(w)}).drop("_k")

        self.steps.append(step)
        return self

    def noise(self, prob: float = 0.2, mean: float = 0.0, std: float = 0.1) -> Chain:
        """Normal noise for each voxel; its deviation is drawn for each sample, from 0 to std."""

        def step(rows: DataFrame, k: int) -> DataFrame:
            places = [a for a in ("z", "y", "x") if a in rows.columns]
            amount = mean + uniform(self.seed, f"{k}/std", *self.by) * std * normal(self.seed, f"{k}/noise", *self.by, *places)
            return rows.withColumn(self.value, F.col(self.value) + F.when(self._chosen(k, prob), amount).otherwise(0.0))

        self.steps.append(step)
        return self

    def contrast(self, prob: float = 0.2, gamma: tuple[float, float] = (0.8, 1.2)) -> Chain:
        """A power of the value within the sample's range; the exponent is drawn for each sample."""

        def step(rows: DataFrame, k: int) -> DataFrame:
            ends = rows.groupBy(*self.by).agg(F.min(self.value).alias("_lo"), F.max(self.value).alias("_hi"))
            power = gamma[0] + uniform(self.seed, f"{k}/gamma", *self.by) * (gamma[1] - gamma[0])
            value = stencil.adjust_contrast(F.col(self.value), power, F.col("_lo"), F.col("_hi"))
            return rows.join(ends, self.by).withColumn(self.value, F.when(self._chosen(k, prob), value).otherwise(F.col(self.value))).drop("_lo", "_hi")

        self.steps.append(step)
        return self

    def scale(self) -> Chain:
        """Each sample's values to the range from 0 to 1; a constant sample becomes 0."""

        def step(rows: DataFrame, k: int) -> DataFrame:
            ends = rows.groupBy(*self.by).agg(F.min(self.value).alias("_lo"), F.max(self.value).alias("_hi"))
            span = F.col("_hi") - F.col("_lo")
            return rows.join(ends, self.by).withColumn(self.value, F.when(span > 0, (F.col(self.value) - F.col("_lo")) / span).otherwise(0.0)).drop("_lo", "_hi")

        self.steps.append(step)
        return self

    def apply(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumns({f"_n{a}": F.lit(n) for a, n in self.shape.items()} | {self.value: F.col(self.value).cast("double")})
        for k, step in enumerate(self.steps):
            out = step(out, k)
        return out.select(*rows.columns)
