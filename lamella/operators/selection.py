"""Filters, slices, class maps and annotation states over voxel rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORE = -100
#: Offsets of classes in encoded instance ids, and the id that marks missing data (fixed values).
CLEFT_OFFSET, MITO_OFFSET, NO_DATA = 1_000_000, 2_000_000, 2**64 - 1


def foreground(rows: DataFrame, label: str = "label") -> DataFrame:
    """Positive labels; negative ones are not foreground."""
    return rows.where(F.col(label) > 0)


def union_foreground(rows: DataFrame, pred: str = "pred", gt: str = "gt", ignore_background: bool = True) -> DataFrame:
    return rows.where((F.col(pred) > 0) | (F.col(gt) > 0)) if ignore_background else rows


def box(rows: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Half-open ranges by axis: box(df, z=(0, 4)). The predicates reach the scan."""
    for axis, (start, stop) in ranges.items():
        rows = rows.where((F.col(axis) >= start) & (F.col(axis) < stop))
    return rows


def clamp(index: int, size: int) -> int:
    return min(max(index, 0), size - 1)


def slice_axis(rows: DataFrame, axis: str, index: int, size: int) -> DataFrame:
    """One slice; the index is clamped to the volume."""
    if axis not in ("z", "y", "x"):
        raise ValueError("axis must be z, y or x")
    return rows.where(F.col(axis) == clamp(index, size))


def downsample(rows: DataFrame, k: int) -> DataFrame:
    """Every k-th voxel on each axis, with new coordinates; k is 1 to 16."""
    if not 1 <= k <= 16:
        raise ValueError("k must be between 1 and 16")
    kept = rows.where(" and ".join(f"{a} % {k} = 0" for a in "zyx"))
    return kept.withColumns({a: F.expr(f"cast({a} div {k} as int)") for a in "zyx"})


def known_targets(rows: DataFrame, target: str, ignore: int = IGNORE) -> DataFrame:
    return rows.where(F.col(target) != ignore)


def has_data(rows: DataFrame, label: str) -> DataFrame:
    """0 < id < 2 ** 64 - 1, for ids kept as decimal(20, 0)."""
    return rows.where((F.col(label) > 0) & (F.col(label) < F.lit(str(NO_DATA)).cast("decimal(20,0)")))


def instance_class(label: Column) -> Column:
    """Class of an offset-encoded id."""
    return F.when(label == 0, 0).when(label < CLEFT_OFFSET, 1).when(label < MITO_OFFSET, 2).otherwise(3)


def class_id(label: Column, dataset: str, default: int = 1, ignore: tuple[str, ...] = ()) -> Column:
    """Class of a label by its dataset's rule; ignored class names give 0."""
    if dataset in ("snemi3d", "microns"):
        rule, names = F.when(label > 0, 1).otherwise(0), {"neuron": 1}
    elif dataset == "cremi3d":
        rule, names = F.when(label <= 0, 0).otherwise(instance_class(label)), {"neuron": 1, "cleft": 2, "mitochondria": 3}
    elif dataset == "mitoem2":
        rule, names = F.when(label == 1, 3).when(label == 2, 4).otherwise(0), {"mitochondria": 3, "boundary": 4}
    else:
        rule, names = F.when(label > 0, default).otherwise(0), {}
    gone = [names[n] for n in ignore if n in names]
    return (F.when(rule.isin(gone), 0).otherwise(rule) if gone else rule).cast("int")


def class_ids(rows: DataFrame, dataset: str, default: int = 1, ignore: tuple[str, ...] = (), label: str = "label") -> DataFrame:
    return rows.withColumns({"class_id": class_id(F.col(label), dataset, default, ignore), "dataset_type": F.lit(dataset)})


def prepared_targets(rows: DataFrame, semantic: str | None = None, label: str = "label") -> DataFrame:
    """semantic_label: the given class or else whether the label is foreground."""
    own = (F.col(label) > 0).cast("int")
    return rows.withColumn("semantic_label", F.coalesce(F.col(semantic).cast("int"), own) if semantic else own)


def annotation_mode(rows: DataFrame, by: list[str], label: str = "label", ignore: int = IGNORE) -> DataFrame:
    """'fractionary' if a sample has unknown, positive and known labels, else 'interactive'."""
    lab = F.col(label)
    seen = rows.groupBy(*by).agg(F.bool_or(lab == ignore).alias("u"), F.bool_or(lab > 0).alias("p"), F.bool_or(lab != ignore).alias("k"))
    return seen.select(*by, F.when(F.col("u") & F.col("p") & F.col("k"), "fractionary").otherwise("interactive").alias("mode"))


def resolve_partial_labels(rows: DataFrame, label: str = "label", semantic: str = "sem", ignore: int = IGNORE) -> DataFrame:
    """Unknown voxels get label 0 and class `ignore`; known positive labels become 1.. in ascending order over all rows."""
    from lamella.operators.relabel import relabel_sequential

    unknown = F.col(label) == ignore
    rows = rows.withColumn(semantic, F.when(unknown, F.lit(ignore)).otherwise(F.col(semantic))).withColumn("semantic_ids", F.col(semantic))
    return relabel_sequential(rows.withColumn(label, F.when(unknown, F.lit(0)).otherwise(F.col(label))), label)


def selected(rows: DataFrame, ids: list[int], label: str = "label") -> DataFrame:
    return rows.where(F.col(label).isin(ids))


def surface(rows: DataFrame, shape: tuple[int, int, int], by: list[str], label: str = "label") -> DataFrame:
    """surface: on the volume's edge, or one of the six neighbours has another label. Missing neighbours count as other."""
    flags = F.lit(False)
    for axis, size in zip("zyx", shape, strict=True):
        others = [a for a in "zyx" if a != axis]
        w = Window.partitionBy(*by, *others).orderBy(axis)
        near = [(F.lag, -1), (F.lead, 1)]
        for step, shift in near:
            ok = (step(axis).over(w) == F.col(axis) + shift) & (step(label).over(w) == F.col(label))
            flags = flags | ~F.coalesce(ok, F.lit(False))
        flags = flags | (F.col(axis) == 0) | (F.col(axis) == size - 1)
    return rows.withColumn("surface", flags)


def label_at(rows: DataFrame, axis: str, index: int, row: int, col: int, shape: tuple[int, int, int], label: str = "label") -> DataFrame:
    """The label under a point of a slice, 0 if there is none; all places are clamped."""
    sizes = dict(zip("zyx", shape, strict=True))
    first, second = [a for a in "zyx" if a != axis]
    at = {axis: index, first: row, second: col}
    found = rows.where(" and ".join(f"{a} = {clamp(v, sizes[a])}" for a, v in at.items()))
    return found.agg(F.coalesce(F.max(label), F.lit(0)).cast("long").alias("label"))


def depth_band(points: DataFrame, centre: int, radius: int) -> DataFrame:
    return points.where(F.abs(F.col("z") - centre) <= radius)


def central_slice(rows: DataFrame, depth: int) -> DataFrame:
    return rows.where(F.col("z") == depth // 2)


def fuse_labels(neuron: DataFrame, cleft: DataFrame, mito: DataFrame, on: list[str], label: str = "label") -> DataFrame:
    """One label a voxel: mitochondria over clefts over cells, with class offsets; missing-data ids are ignored."""
    c = has_data(cleft, label).select(*on, (F.col(label) + CLEFT_OFFSET).cast("long").alias("_c"))
    m = has_data(mito, label).select(*on, (F.col(label) + MITO_OFFSET).cast("long").alias("_m"))
    joined = neuron.join(c, on, "left").join(m, on, "left")
    return joined.withColumn(label, F.coalesce("_m", "_c", F.col(label).cast("long"), F.lit(0)).cast("long")).drop("_c", "_m")


def split_by_depth(rows: DataFrame, depth: int, train_share: float) -> DataFrame:
    """split: 'train' below the whole part of depth * share, 'valid' above. The share is taken as the decimal number it is written as."""
    return rows.withColumn("split", F.when(F.col("z") < int(depth * Decimal(str(train_share))), "train").otherwise("valid"))


def repeat_rows(rows: DataFrame, factor: int, index: str = "idx", length: int | None = None) -> DataFrame:
    """Virtual repetition: row i stands at i, i + length, ...; length defaults to the count of rows."""
    n = rows.count() if length is None else length
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("virtual_idx", F.col(index) + F.col("copy") * n)


def virtual_length(rows: DataFrame, length: int, index: str = "idx") -> DataFrame:
    """`length` virtual rows; virtual row i is row i modulo the count of rows."""
    n = rows.count()
    spark = rows.sparkSession
    return spark.range(length).withColumnRenamed("id", "virtual_idx").withColumn(index, F.pmod("virtual_idx", F.lit(n))).join(rows, index)


def weighted_draw(sizes: DataFrame, weight: str, draws: int, unit: str = "dataset") -> DataFrame:
    """draw 0..draws-1 -> unit: with replacement, by weight times size; uniforms come from a linear congruence of the draw.

    sizes has few rows (datasets); the cumulative shares are a broadcast of that size.
    """
    rows = sorted((r[unit], float(r[weight]) * r["n"]) for r in sizes.collect())
    total, edge, out = sum(w for _, w in rows), 0.0, None
    u = F.pmod(F.col("draw") * 1103515245 + 12345, F.lit(2**31)) / F.lit(float(2**31))
    for name, w in rows[:-1]:
        edge += w / total
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    out = F.lit(rows[-1][0]) if out is None else out.otherwise(rows[-1][0])
    return sizes.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn(unit, out)


def stack_depth(volumes: list[DataFrame], depths: list[int]) -> DataFrame:
    """Volumes one behind the other along z."""
    out, offset = None, 0
    for rows, depth in zip(volumes, depths, strict=True):
        moved = rows.withColumn("z", (F.col("z") + offset).cast("int"))
        out = moved if out is None else out.unionByName(moved, allowMissingColumns=True)
        offset += depth
    return out
