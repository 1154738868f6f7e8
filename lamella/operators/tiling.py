"""Patch grids, overlaps, extraction, sliding-window prediction, blending and stitching.

The patches along an axis are arithmetic: starts are multiples of the stride, the last one at the end of the axis. Which
of them cover a place is a range of numbers, so neither grids nor covers are listed anywhere, for one volume or a table
of volumes of different shapes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalar import gaussian_weight, lp_distance
from lamella.operators.aggregates import instance_means
from lamella.operators.relabel import component_labels, drop_small, relabel_sequential
from lamella.plans.graph import connected_components
from lamella.plans.rank import numbered_within

AXES = "zyx"


def window_starts(size: int, patch: int, stride: int | None = None, cover: str = "full") -> list[int]:
    """Starts along one axis. cover='reference' leaves a tail that the stride doesn't reach; 'full' adds a last patch at the end."""
    stride = stride or max(1, patch // 2)
    room = max(size, patch) - patch
    return [*range(0, room + 1, stride), *([room] if cover == "full" and room % stride else [])]


def overlap_stride(patch: int, overlap: float = 0.25) -> int:
    return max(1, int(patch * (1 - overlap)))


def overlap_starts(size: int, patch: int, overlap: float = 0.25) -> list[int]:
    """Starts with a share of overlap; the last patch is moved back to end at the edge."""
    return window_starts(size, patch, overlap_stride(patch, overlap))


class Windows:
    """The patches along one axis of `size` places (a number or a column): start(k) for k from 0 to count - 1."""

    def __init__(self, size, patch: int, stride: int | None = None, cover: str = "full"):
        self.patch, self.stride = patch, stride or max(1, patch // 2)
        size = size if isinstance(size, Column) else F.lit(size)
        self.room = F.greatest(size, F.lit(patch)).cast("long") - patch
        regular = F.floor(self.room / self.stride) + 1
        self.tail = (self.room % self.stride != 0) if cover == "full" else F.lit(False)
        self.regular, self.count = regular, regular + self.tail.cast("long")

    def start(self, k: Column) -> Column:
        return F.least(k * self.stride, self.room)

    def every(self) -> Column:
        return F.sequence(F.lit(0).cast("long"), self.count - 1)

    def covering(self, first: Column, last: Column) -> Column:
        """Numbers of the patches that hold a place from first to last (both included, within the axis)."""
        low = F.greatest(F.floor((first - self.patch) / self.stride) + 1, F.lit(0)).cast("long")
        high = F.when(self.tail & (self.room <= last), self.regular).otherwise(F.least(F.floor(last / self.stride), self.regular - 1)).cast("long")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def _grid(volumes: DataFrame, by: list[str], windows: dict[str, Windows], inside: bool) -> DataFrame:
    out = volumes.select(*by, *[f"n{a}" for a in AXES])
    for a in AXES:
        out = out.withColumn(f"_k{a}", F.explode(windows[a].every()))
    index = F.col("_kz")
    for a in "yx":
        index = index * windows[a].count + F.col(f"_k{a}")
    starts = {a: windows[a].start(F.col(f"_k{a}")) for a in AXES}
    ends = {a: F.least(s + windows[a].patch, F.col(f"n{a}")) if inside else s + windows[a].patch for a, s in starts.items()}
    return out.select(*by, index.cast("long").alias("patch_idx"), *[s.cast("int").alias(f"{a}0") for a, s in starts.items()], *[e.cast("int").alias(f"{a}1") for a, e in ends.items()])


def window_grid(volumes: DataFrame, patch: dict[str, int], stride: dict[str, int] | None = None, cover: str = "full", by: list[str] | None = None) -> DataFrame:
    """(by, patch_idx, z0, y0, x0, z1, y1, x1) of the sliding windows of each volume (by, nz, ny, nx), in raster order."""
    return _grid(volumes, by or [], {a: Windows(F.col(f"n{a}"), patch[a], (stride or {}).get(a), cover) for a in AXES}, False)


def overlap_grid(volumes: DataFrame, patch: dict[str, int], overlap: float = 0.25, by: list[str] | None = None) -> DataFrame:
    """The same with a share of overlap; patches end at the volume's edge."""
    return _grid(volumes, by or [], {a: Windows(F.col(f"n{a}"), patch[a], overlap_stride(patch[a], overlap)) for a in AXES}, True)


def volume_shapes(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, nz, ny, nx): how far the voxels of each volume reach."""
    return rows.groupBy(*(by or [])).agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])


def patch_overlaps(patches: DataFrame, cell: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Pairs i < j of a volume's patches whose boxes meet, with the intersection.

    Boxes are put into the grid cells they cover and met there by equality; `cell` is about a patch's size, so a
    box covers a few cells and a cell holds a few boxes.
    """
    by = by or []
    p = patches
    for a in AXES:
        p = p.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / cell[a]), F.floor((F.col(f"{a}1") - 1) / cell[a]))))
    i = p.select(*by, F.col("patch_idx").alias("i"), *[F.col(f"{a}{e}").alias(f"i{a}{e}") for a in AXES for e in "01"], *[f"c{a}" for a in AXES])
    j = p.select(*by, F.col("patch_idx").alias("j"), *[F.col(f"{a}{e}").alias(f"j{a}{e}") for a in AXES for e in "01"], *[f"c{a}" for a in AXES])
    lo = {a: F.greatest(f"i{a}0", f"j{a}0") for a in AXES}
    hi = {a: F.least(f"i{a}1", f"j{a}1") for a in AXES}
    met = i.join(j, [*by, *[f"c{a}" for a in AXES]]).where("i < j")
    for a in AXES:
        met = met.where((lo[a] < hi[a]) & (F.col(f"c{a}") == F.floor(lo[a] / cell[a])))  # a pair counts in one cell only
    return met.select(*by, "i", "j", *[lo[a].alias(f"{a}0") for a in AXES], *[hi[a].alias(f"{a}1") for a in AXES])


def extract_patches(rows: DataFrame, shape: dict[str, int], patch: dict[str, int], stride: dict[str, int] | None = None, cover: str = "full") -> DataFrame:
    """Each voxel once for every patch that holds it: patch_idx, and places d<axis> in the patch.

    The covering patches of each axis are a range of numbers, so this is an explode by arithmetic.
    """
    out, index = rows, F.lit(0).cast("long")
    for a in AXES:
        windows = Windows(shape[a], patch[a], (stride or {}).get(a), cover)
        out = out.withColumn(f"_{a}", F.explode(windows.covering(F.col(a), F.col(a))))
        out = out.withColumn(f"d{a}", (F.col(a) - windows.start(F.col(f"_{a}"))).cast("int"))
        index = index * windows.count + F.col(f"_{a}")
    return out.withColumn("patch_idx", index).drop("_z", "_y", "_x")


def blend_patches(predictions: DataFrame, patch: dict[str, int], value: str = "value", keys: list[str] | None = None, mode: str = "gaussian") -> DataFrame:
    """One value a voxel (and key) from overlapping patches: weighted mean by the centre weight, or the maximum."""
    on = [*(keys or []), *AXES]
    if mode == "max":
        return predictions.groupBy(*on).agg(F.max(value).alias(value))
    w = gaussian_weight([F.col(f"d{a}") for a in AXES], [patch[a] for a in AXES])
    return predictions.groupBy(*on).agg((F.sum(F.col(value) * w) / (F.sum(w) + 1e-8)).alias(value))


def best_embedding(predictions: DataFrame, prob: str, embedding: str) -> DataFrame:
    """For the maximum blend: the embedding of the patch with the largest probability (smaller patch_idx on ties)."""
    return predictions.groupBy(*AXES).agg(F.max(prob).alias(prob), F.max_by(embedding, F.struct(F.col(prob), -F.col("patch_idx"))).alias(embedding))


def patch_weight(sizes: list[int], sigma_scale: float = 0.125) -> np.ndarray:
    """The centre weight as an array: highest at half the size, where it is 1."""
    sigma = max(min(sizes) * sigma_scale, 1e-12)
    squares = sum(np.meshgrid(*[(np.arange(s) - s / 2) ** 2 for s in sizes], indexing="ij"))
    return np.exp(-(squares - squares.min()) / (2 * sigma * sigma))


def predict_patches(rows: DataFrame, by: list[str], shape: dict[str, int], patch: dict[str, int], model: Callable, stride: dict[str, int] | None = None, cover: str = "full", mode: str = "gaussian", chunk: dict[str, int] | None = None, value: str = "intensity", sigma_scale: float = 0.125) -> DataFrame:
    """Run `model` on every patch and blend its heads: (by, z, y, x, semantic, instance), arrays for each voxel.

    model takes a float array (d, h, w) and returns scores (classes, d, h, w), or a dict: 'semantic' (or 'logits') and,
    if it has a second head, 'instance' (channels, d, h, w); a softmax over the classes follows, unless the first head is
    'probability', which is taken as it is. 'gaussian' blends both heads by the centre weight; 'max' takes each class's
    largest probability and the embedding of the patch with the largest probability (of equals the first patch). A volume
    smaller than the patch is reflected; voxels without a row are 0. instance is null with one head.

    Voxels travel as chunks (an array each): a chunk is sent to the patches that meet it, a patch is assembled from its
    chunks, and its prediction goes back as an array a chunk, where the overlapping patches are summed. So the rows shuffled
    are chunks times patches that meet them; work a voxel depends on the overlap alone.
    """
    sizes = [patch[a] for a in AXES]
    cells = [(chunk or {}).get(a, min(64, patch[a])) for a in AXES]
    bounds = [max(shape[a], 1) for a in AXES]
    windows = {a: Windows(shape[a], patch[a], (stride or {}).get(a), cover) for a in AXES}
    steps, rooms = [windows[a].stride for a in AXES], [max(shape[a], patch[a]) - patch[a] for a in AXES]
    at = sum(((F.col(a) % c).cast("int") * math.prod(cells[k + 1 :]) for k, (a, c) in enumerate(zip(AXES, cells, strict=True))), F.lit(0))
    places = [f"c{a}" for a in AXES]
    chunks = rows.select(*by, *[F.floor(F.col(a) / c).cast("int").alias(f"c{a}") for a, c in zip(AXES, cells, strict=True)], F.struct(at.alias("i"), F.col(value).cast("double").alias("v")).alias("_v"))
    chunks = chunks.groupBy(*by, *places).agg(F.collect_list("_v").alias("_v")).select(*by, *places, F.col("_v.i").alias("i"), F.col("_v.v").alias("v"))
    sent = chunks
    for a, c in zip(AXES, cells, strict=True):
        first = F.col(f"c{a}") * c
        sent = sent.withColumn(f"k{a}", F.explode(windows[a].covering(first, F.least(first + c, F.lit(shape[a])) - 1).cast("array<int>")))

    def corner(k) -> list[int]:
        return [min(int(n) * s, r) for n, s, r in zip(k, steps, rooms, strict=True)]

    def meets(start: list[int], cell) -> tuple[tuple[slice, ...], tuple[slice, ...]] | None:
        """Where a patch and a chunk overlap, in the patch's and in the chunk's own places."""
        low = [max(s, int(c) * n) for s, c, n in zip(start, cell, cells, strict=True)]
        high = [min(s + p, (int(c) + 1) * n, b) for s, p, c, n, b in zip(start, sizes, cell, cells, bounds, strict=True)]
        if any(a >= b for a, b in zip(low, high, strict=True)):
            return None
        return tuple(slice(a - s, b - s) for a, b, s in zip(low, high, start, strict=True)), tuple(slice(a - int(c) * n, b - int(c) * n) for a, b, c, n in zip(low, high, cell, cells, strict=True))

    keys = [*by, *places, "kz", "ky", "kx"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    of_by = "".join(f"{b} {kinds[b]}, " for b in by)

    def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column of lists, and where each list starts in them."""
        column = column.combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(column.value_lengths().to_numpy()))

    def numbers(table: pa.Table, names: list[str]) -> np.ndarray:
        return np.stack([table[n].to_numpy() for n in names], 1)

    def apply(table: pa.Table) -> pa.Table:
        start, own_cells = corner([table[k][0].as_py() for k in ("kz", "ky", "kx")]), numbers(table, places)
        met = [meets(start, cell) for cell in own_cells]
        (i, ends), (v, _) = lists(table["i"]), lists(table["v"])
        block = np.zeros(sizes)
        for k, (own, theirs) in enumerate(met):
            whole = np.zeros(cells)
            whole.ravel()[i[ends[k] : ends[k + 1]]] = v[ends[k] : ends[k + 1]]
            block[own] = whole[theirs]
        inside = [min(b - s, p) for b, s, p in zip(bounds, start, sizes, strict=True)]
        if inside != sizes:
            block = np.pad(block[tuple(slice(0, n) for n in inside)], [(0, p - n) for p, n in zip(sizes, inside, strict=True)], mode="reflect")
        got = model(block)
        heads = got if isinstance(got, dict) else {"semantic": got}
        if heads.get("probability") is not None:
            prob = np.asarray(heads["probability"], float)
        else:
            scores = np.asarray(heads.get("semantic", heads.get("logits")), float)
            scores = np.exp(scores - scores.max(axis=0, keepdims=True))
            prob = scores / scores.sum(axis=0, keepdims=True)
        second = np.asarray(heads["instance"], float) if heads.get("instance") is not None else None
        cuts = [(slice(None), *own) for own, _ in met]
        sem = pa.array([prob[c].tobytes() for c in cuts], pa.binary())
        ins = pa.array([None if second is None else second[c].tobytes() for c in cuts], pa.binary())
        return table.select(keys).append_column("sem", sem).append_column("ins", ins)

    weight = patch_weight(sizes, sigma_scale)
    within = np.indices(cells).reshape(3, -1).T

    def blend(table: pa.Table) -> pa.Table:
        cell, at = numbers(table.slice(0, 1), places)[0], numbers(table, ["kz", "ky", "kx"])
        sems, inss = table["sem"].combine_chunks(), table["ins"].combine_chunks()
        total = embed = None
        weights = np.zeros(cells)
        for k in np.lexsort(at.T[::-1]).tolist():
            own, theirs = meets(corner(at[k]), cell)
            span = [s.stop - s.start for s in own]
            prob = np.frombuffer(sems[k].as_buffer()).reshape(-1, *span)
            vec = np.frombuffer(inss[k].as_buffer()).reshape(-1, *span) if inss[k].is_valid else None
            if total is None:
                total = np.zeros((len(prob), *cells))
                embed = None if vec is None else np.zeros((len(vec), *cells))
            here = (slice(None), *theirs)
            if mode == "max":
                better = prob.max(0) > total[here].max(0)
                total[here] = np.maximum(total[here], prob)
                if vec is not None:
                    embed[here] = np.where(better, vec, embed[here])
            else:
                w = weight[own]
                total[here] += prob * w
                weights[theirs] += w
                if vec is not None:
                    embed[here] += vec * w
        if mode != "max":
            total /= weights + 1e-8
            embed = None if embed is None else embed / (weights + 1e-8)
        spots = within + cell * np.array(cells)
        ok = (spots < bounds).all(1)
        n = int(ok.sum())

        def arrays(field: np.ndarray) -> pa.Array:
            values = field.reshape(len(field), -1).T[ok]
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(field), pa.int32()), pa.array(values.ravel()))

        first = pa.array(np.zeros(n, np.int64))
        out = {b: table[b].take(first) for b in by} | {a: pa.array(spots[ok, k].astype(np.int32)) for k, a in enumerate(AXES)}
        out["semantic"] = arrays(total)
        out["instance"] = pa.nulls(n, pa.list_(pa.float64())) if embed is None else arrays(embed)
        return pa.table(out)

    of_places = ", ".join(f"{n} int" for n in [*places, "kz", "ky", "kx"])
    parts = sent.groupBy(*by, "kz", "ky", "kx").applyInArrow(apply, f"{of_by}{of_places}, sem binary, ins binary")
    return parts.groupBy(*by, *places).applyInArrow(blend, f"{of_by}z int, y int, x int, semantic array<double>, instance array<double>")


def sliding_window(rows: DataFrame, shape: dict[str, int], patch: dict[str, int], model, classes: int, stride: dict[str, int] | None = None, mode: str = "gaussian", cover: str = "full", value: str = "intensity") -> DataFrame:
    """The first head of predict_patches, a row a class: (z, y, x, class_id, prob)."""
    got = predict_patches(rows, [], shape, patch, model, stride, cover, mode, value=value)
    return got.select(*AXES, F.posexplode(F.slice("semantic", 1, classes)).alias("class_id", "prob"))


def argmax_class(probabilities: DataFrame) -> DataFrame:
    """The class of the largest probability, the first of equals."""
    return probabilities.groupBy(*AXES).agg(F.max_by("class_id", F.struct(F.col("prob"), -F.col("class_id"))).alias("class_id"))


def stitch(rows: DataFrame, patches: DataFrame, cell: dict[str, int], merge_threshold: float = 0.5, least: int = 50, spatial_dims: int = 3, embedding: str = "embedding") -> DataFrame:
    """Merge instance ids whose mean embeddings are close inside an overlap of patches.

    rows: z, y, x, lin, label, embedding. Ids of an overlap closer than the threshold are linked, components get one
    id, 3-D components are split where they are not connected, small ones go, and ids become sequential.
    """
    boxes = patch_overlaps(patches, cell).withColumn("box", F.struct("i", "j"))
    inside = rows.where("label > 0")
    for a in AXES:
        boxes = boxes.withColumn(f"g{a}", F.explode(F.sequence(F.floor(F.col(f"{a}0") / cell[a]), F.floor((F.col(f"{a}1") - 1) / cell[a]))))
        inside = inside.withColumn(f"g{a}", F.floor(F.col(a) / cell[a]))
    held = inside.join(boxes, [f"g{a}" for a in AXES])
    for a in AXES:
        held = held.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")))
    means = instance_means(held.select("box", "label", embedding), embedding, by=["box"])
    a, b = means.alias("a"), means.alias("b")
    close = a.join(b, (F.col("a.box") == F.col("b.box")) & (F.col("a.label") < F.col("b.label")))
    close = close.where(lp_distance(F.col("a.mean"), F.col("b.mean")) < merge_threshold)
    parts = connected_components(close.select(F.col("a.label").alias("src"), F.col("b.label").alias("dst")))
    out = rows.join(parts, rows["label"] == parts["node"], "left").withColumn("label", F.coalesce("component", "label")).select(*rows.columns)
    if spatial_dims == 3:
        out = component_labels(out.withColumn("_s", F.lit(0)), ["_s"], 3).withColumn("label", F.col("component")).select(*rows.columns)
    return relabel_sequential(drop_small(out, least))


def every_nth(rows: DataFrame, n: int, order: list[str], by: list[str]) -> DataFrame:
    """Every n-th row in raster order of each group."""
    return numbered_within(rows, by, order, "_k").where(F.col("_k") % n == 0).drop("_k")
