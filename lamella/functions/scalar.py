"""Scalar and array expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def minmax(value: Column, low: Column, high: Column, variant: str = "guard") -> Column:
    """Min-max normalisation: 'guard' leaves a constant volume as it is, 'eps' adds 1e-8, 'clamp' divides by 1e-5 at least."""
    if variant == "guard":
        return F.when(high > low, (value - low) / (high - low)).otherwise(value)
    if variant == "eps":
        return (value - low) / (high - low + EPS)
    if variant == "clamp":
        return (value - low) / F.greatest(high - low, F.lit(1e-5))
    raise ValueError(f"unknown variant {variant!r}")


def to_uint8(value: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < EPS, F.lit(0)).otherwise(((value - low) / (high - low) * 255).cast("int"))


def fold_id(label: Column, modulus: int = 256) -> Column:
    return F.pmod(label, F.lit(modulus)).cast("int")


def blend(gray: Column, colour: Column, alpha: Column, rounding: str = "trunc") -> Column:
    mixed = F.least(F.greatest((1 - alpha) * gray + alpha * colour, F.lit(0.0)), F.lit(255.0))
    return (F.floor(mixed) if rounding == "trunc" else F.floor(mixed + 0.5)).cast("int")


def gaussian_weight(places: list[Column], patch: list[int], sigma_scale: float = 0.125) -> Column:
    """Centre weight of a patch; the centre is at half the size, sigma is a share of the smallest side. The maximum is 1."""
    sigma = max(min(patch) * sigma_scale, 1e-12)
    squares = reduce(lambda a, b: a + b, [F.pow(p - F.lit(s / 2.0), 2) for p, s in zip(places, patch, strict=True)])
    least = sum((s // 2 - s / 2.0) ** 2 for s in patch)
    return F.exp(-(squares - F.lit(least)) / F.lit(2.0 * sigma * sigma))


def anisotropy(x: Column, y: Column, z: Column) -> Column:
    return z / ((x + y) / 2)


def physical_size(shape: list[Column], spacing: list[Column]) -> list[Column]:
    return [n * s for n, s in zip(shape, spacing, strict=True)]


def linear_index(z: Column, y: Column, x: Column, height: int, width: int) -> Column:
    return (z.cast("long") * height + y) * width + x


def x_fastest_index(z: Column, y: Column, x: Column, height: int, depth: int) -> Column:
    """The index of a voxel when z, y, x are stored with x slowest: the transposed order."""
    return (x.cast("long") * height + y) * depth + z


def hinge_pull(distance: Column, margin: float) -> Column:
    return F.pow(F.greatest(distance - margin, F.lit(0.0)), 2)


def hinge_push(distance: Column, margin: float) -> Column:
    return F.pow(F.greatest(2 * margin - distance, F.lit(0.0)), 2)


def _fold(a: Column, start: float = 0.0) -> Column:
    return F.aggregate(a, F.lit(start).cast("double"), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")))


def lp_distance(a: Column, b: Column, p: int = 2) -> Column:
    if p == 1:
        return _fold(F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double"))))
    return F.pow(_fold(F.zip_with(a, b, lambda u, v: F.pow(F.abs(u.cast("double") - v.cast("double")), p))), 1.0 / p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def unit(a: Column, eps: float = 1e-6) -> Column:
    return F.transform(a, lambda v: v / (norm(a) + eps))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


_KERNELS = {"mse": "mse", "l2": "mse", "l1": "l1", "mae": "l1", "smooth_l1": "smooth_l1", "huber": "smooth_l1"}


def regression_kernel(name: str, difference: Column, beta: float = 1.0) -> Column:
    """Loss of one difference; unknown names raise ValueError."""
    kind = _KERNELS.get(name)
    if kind is None:
        raise ValueError(f"unknown loss kernel {name!r}")
    size = F.abs(difference)
    if kind == "mse":
        return difference * difference
    if kind == "l1":
        return size
    return F.when(size < beta, 0.5 * size * size / beta).otherwise(size - 0.5 * beta)


def vote_bin(vote: Column, size: float) -> Column:
    """Half-to-even rounding."""
    return F.rint(vote / size).cast("long")


def one_hot(label: Column, classes: int, mode: str = "sigmoid") -> Column:
    """sigmoid: a negative label counts as class 0; softmax: a negative label is null."""
    known = F.greatest(label, F.lit(0)) if mode == "sigmoid" else F.when(label >= 0, label)
    return F.when(known.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == known).cast("double")))


def parse_spacing(text: Column) -> Column:
    """'sz,sy,sx' as three doubles; null if there are not exactly three numbers."""
    cast = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when((F.size(cast) == 3) & ~F.exists(cast, lambda v: v.isNull()), cast)


def parse_ids(text: Column) -> Column:
    """A comma-separated list of integers; an odd list gives an empty selection."""
    ids = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("long"))
    return F.when(text.isNull() | F.exists(ids, lambda v: v.isNull()), F.array().cast("array<bigint>")).otherwise(ids)


def row_norms(rows: Column) -> Column:
    """L2 norm of each non-null row of an array of arrays (spacing from direction vectors)."""
    return F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: norm(r))
