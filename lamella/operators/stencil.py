"""Neighbourhood operators as windows along one axis after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _along(axis: str, by: list[str], axes: str):
    return Window.partitionBy(*by, *[a for a in axes if a != axis]).orderBy(axis)


def fill_missing_sections(rows: DataFrame, missing: list[int], value: str = "intensity", by: list[str] | None = None, mode: str = "interpolate") -> DataFrame:
    """Sections z in `missing` (inner ones) take the mean of their neighbours, a copy of the one before, or zero."""
    if mode not in ("interpolate", "copy", "zero"):
        raise ValueError("mode must be interpolate, copy or zero")
    w = _along("z", by or [], "zyx")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    filled = {"interpolate": (before + after) / 2, "copy": before, "zero": F.lit(0.0)}[mode]
    inner = before.isNotNull() & after.isNotNull()
    return rows.withColumn(value, F.when(F.col("z").isin(missing) & inner, filled).otherwise(F.col(value)))


def central_gradient(rows: DataFrame, value: str, by: list[str], axes: str = "yx") -> DataFrame:
    """g_<axis>: half the difference of the neighbours, one-sided at the ends, 0 on an axis of one voxel."""
    out = {}
    for axis in axes:
        w = _along(axis, by, axes)
        before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        inner = (after - before) / 2
        out[f"g_{axis}"] = F.coalesce(F.when(before.isNotNull() & after.isNotNull(), inner).when(before.isNull(), after - own).otherwise(own - before), F.lit(0.0))
    return rows.withColumns(out)


def boundary_weight(rows: DataFrame, by: list[str], weight: float = 10.0, label: str = "label", axes: str = "yx", name: str = "weight") -> DataFrame:
    """`weight` where the 3-wide neighbourhood holds several labels, else 1; the edge repeats the outermost voxel."""
    low, high = F.col(label), F.col(label)
    out = rows.withColumns({"_lo": low, "_hi": high})
    for axis in axes:
        w = _along(axis, by, axes).rowsBetween(-1, 1)
        out = out.withColumns({"_lo": F.min("_lo").over(w), "_hi": F.max("_hi").over(w)})
    return out.withColumn(name, 1.0 + (F.col("_lo") != F.col("_hi")).cast("double") * (weight - 1.0)).drop("_lo", "_hi")


def box_smooth(rows: DataFrame, value: str, radius: int, by: list[str], axes: str = "yx", name: str = "smooth") -> DataFrame:
    """Mean over (2 * radius + 1) per axis with zero padding: the divisor is constant. The grid has to be dense."""
    out = rows.withColumn(name, F.col(value).cast("double"))
    for axis in axes:
        out = out.withColumn(name, F.sum(name).over(_along(axis, by, axes).rowsBetween(-radius, radius)) / (2 * radius + 1))
    return out


def flip(rows: DataFrame, axis: str, size: int) -> DataFrame:
    return rows.withColumn(axis, (size - 1 - F.col(axis)).cast("int"))


def rot90(rows: DataFrame, a: str, b: str, size_b: int) -> DataFrame:
    """A quarter turn in the plane of a and b, from a towards b: (a, b) -> (size_b - 1 - b, a)."""
    return rows.withColumns({a: (size_b - 1 - F.col(b)).cast("int"), b: F.col(a)})


def crop(rows: DataFrame, start: dict[str, int], size: dict[str, int]) -> DataFrame:
    for axis, s in start.items():
        rows = rows.where((F.col(axis) >= s) & (F.col(axis) < s + size[axis])).withColumn(axis, (F.col(axis) - s).cast("int"))
    return rows


def center_crop(rows: DataFrame, shape: dict[str, int], size: dict[str, int]) -> DataFrame:
    return crop(rows, {a: max((shape[a] - s) // 2, 0) for a, s in size.items()}, size)


def spatial_pad(rows: DataFrame, shape: dict[str, int], size: dict[str, int]) -> DataFrame:
    """Shift into the middle of the larger size; voxels without a row are the padding's zeros."""
    return rows.withColumns({a: (F.col(a) + max((s - shape[a]) // 2, 0)).cast("int") for a, s in size.items()})


def reflect_index(place, size: int):
    """The source of a place outside [0, size) under reflection without repeating the edge."""
    if size == 1:
        return F.lit(0)
    period = 2 * (size - 1)
    m = F.pmod(place, F.lit(period))
    return F.least(m, period - m)


def reflect_pad(rows: DataFrame, axis: str, size: int, before: int, after: int) -> DataFrame:
    """Rows repeated by reflection along an axis; the new axis has size + before + after places."""
    targets = F.sequence(F.lit(0), F.lit(size + before + after - 1))
    sources = F.transform(targets, lambda t: F.struct(t.alias("t"), reflect_index(t - before, size).cast("int").alias("s")))
    hit = F.filter(sources, lambda p: p["s"] == F.col(axis))
    return rows.withColumn("_p", F.explode(hit)).withColumn(axis, F.col("_p.t").cast("int")).drop("_p")


def _same_source(place):
    return lambda p: p["s"] == place


def resize_nearest(rows: DataFrame, shape: dict[str, int], size: dict[str, int]) -> DataFrame:
    """Nearest resizing: place t takes floor(t * old / new)."""
    for axis, new in size.items():
        old = shape[axis]
        sources = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(t * old // new).alias("s")) for t in range(new)])
        own = F.col(axis)
        rows = rows.withColumn("_p", F.explode(F.filter(sources, _same_source(own)))).withColumn(axis, F.col("_p.t").cast("int")).drop("_p")
    return rows


def line_defects(rows: DataFrame, bands: DataFrame, value: str = "intensity", by: list[str] | None = None) -> DataFrame:
    """Multiply bands of rows or columns: bands(by, axis, start, width, factor), clipped to [0, 1].

    There are a few bands a sample; they are collected per sample into an array, so each voxel is read once.
    """
    keys = by or []
    packed = bands.groupBy(*keys).agg(F.collect_list(F.struct("axis", "start", "width", "factor")).alias("_bands"))
    joined = rows.join(packed, keys, "left") if keys else rows.crossJoin(F.broadcast(packed))
    place = lambda b: F.when(b["axis"] == "y", F.col("y")).otherwise(F.col("x"))
    factor = F.aggregate(F.coalesce("_bands", F.array()), F.lit(1.0), lambda acc, b: acc * F.when((place(b) >= b["start"]) & (place(b) < b["start"] + b["width"]), b["factor"].cast("double")).otherwise(1.0))
    return joined.withColumn(value, F.least(F.greatest(F.col(value) * factor, F.lit(0.0)), F.lit(1.0))).drop("_bands")


def intensity_defect(value, scale, shift):
    return F.least(F.greatest(value * scale + shift, F.lit(0.0)), F.lit(1.0))


def adjust_contrast(value, gamma, low, high):
    return F.pow((value - low) / (high - low + 1e-7), gamma) * (high - low) + low


def elastic_deform(rows: DataFrame, displacement: DataFrame, shape: tuple[int, int], by: list[str], columns: list[str]) -> DataFrame:
    """Warp sections by a displacement table (y, x, dy, dx): the source is clipped, then truncated to a voxel."""
    h, w = shape
    moved = displacement.select(
        F.col("y").alias("ty"),
        F.col("x").alias("tx"),
        F.least(F.greatest(F.col("y") + F.col("dy"), F.lit(0.0)), F.lit(h - 1.0)).cast("int").alias("y"),
        F.least(F.greatest(F.col("x") + F.col("dx"), F.lit(0.0)), F.lit(w - 1.0)).cast("int").alias("x"),
    )
    joined = rows.join(moved, ["y", "x"])
    return joined.select(*by, F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x"), *columns)


def linear_lookup(points: DataFrame, field: DataFrame, by: list[str], value: str = "value", axes: str = "yx") -> DataFrame:
    """points(by, id, p<axis>) -> sampled value of field(by, places, value): linear along each axis, zero where there is no row."""
    corners = [()]
    for _ in axes:
        corners = [(*c, d) for c in corners for d in (0, 1)]
    low = {a: F.floor(f"p{a}").cast("int") for a in axes}
    part = {a: F.col(f"p{a}") - low[a] for a in axes}

    def corner(c):
        weight = F.lit(1.0)
        for a, d in zip(axes, c, strict=True):
            weight = weight * (part[a] if d else 1 - part[a])
        return F.struct(*[(low[a] + d).alias(a) for a, d in zip(axes, c, strict=True)], weight.alias("w"))

    exploded = points.select(*by, "id", F.explode(F.array(*map(corner, corners))).alias("c")).select(*by, "id", "c.*")
    exploded = exploded.where("w > 0 or w is null")
    joined = exploded.join(field.select(*by, *axes, F.col(value).alias("_v")), [*by, *axes], "left")
    return joined.groupBy(*by, "id").agg(F.sum(F.col("w") * F.coalesce("_v", F.lit(0.0))).alias(value))


def bilinear_lookup(points: DataFrame, field: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """linear_lookup in two dimensions."""
    return linear_lookup(points, field, by, value)
