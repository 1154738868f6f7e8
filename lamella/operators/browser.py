"""Volume-browser queries: slices with overlays, chunks, metadata, palettes, splat points."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.scalar import blend, fold_id, to_uint8
from lamella.operators.selection import downsample, label_at, slice_axis, surface
from lamella.operators.tiling import every_nth


def palette(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, r, g, b): a fixed colour for each positive label by an arithmetic hash; 0 is black."""
    ids = rows.select(label).distinct()
    channel = lambda k: F.when(F.col(label) <= 0, 0).otherwise(F.pmod(F.col(label) * (1103515245 + 2 * k) + 12345 * (k + 1), F.lit(200)) + 56).cast("int")
    return ids.select(label, channel(0).alias("r"), channel(1).alias("g"), channel(2).alias("b"))


def downsample_choice(shape: tuple[int, int, int], most_xy: int = 512, most_voxels: int = 40_000_000) -> int:
    """The step for an interactive chunk: the larger side to most_xy at most, then up to the voxel budget or 16."""
    k = max(1, math.ceil(max(shape[1:]) / most_xy))
    while k < 16 and math.prod(math.ceil(n / k) for n in shape) > most_voxels:
        k += 1
    return min(k, 16)


def png_bytes(image: np.ndarray) -> bytes:
    """An RGBA image (rows, cols, 4) as PNG: rows without a filter, in one stream."""
    rows, cols, _ = image.shape

    def part(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = np.concatenate((np.zeros((rows, 1), np.uint8), image.reshape(rows, cols * 4)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">2I5B", cols, rows, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes(), 1)) + part(b"IEND", b"")


@dataclass(frozen=True)
class Volume:
    """A registered volume: voxel rows with z, y, x, intensity and, if it has a segmentation, label."""

    volume_id: str
    rows: DataFrame
    shape: tuple[int, int, int]
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    label: str | None = "label"

    def _bytes(self, rows: DataFrame) -> DataFrame:
        ends = self.rows.agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))  # one row
        return rows.join(F.broadcast(ends), how="cross").withColumn("u8", to_uint8(F.col("intensity"), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")

    def meta(self) -> DataFrame:
        n = F.count_distinct(self.label) if self.label else F.lit(0)
        out = self.rows.agg(n.cast("long").alias("num_labels"))
        return out.select(F.lit(self.volume_id).alias("volume_id"), F.array(*map(F.lit, self.shape)).alias("shape"), F.array(*map(F.lit, self.spacing)).alias("spacing"), F.lit(self.label is not None).alias("has_seg"), "num_labels")

    def labels(self) -> DataFrame:
        return palette(self.rows.where(F.col(self.label) > 0), self.label)

    def slice(self, axis: str, index: int, opacity: float = 0.5, selected: list[int] | None = None, overlay: bool = True, client: bool = False) -> DataFrame:
        """(row, col, r, g, b): gray bytes with the labels' colours over them; labels that aren't selected are dimmed.

        client: as a viewer draws it, where the x slice has y downwards and z to the right, so that it lies beside the z
        slice, and colours are rounded and not cut.
        """
        sizes = dict(zip("zyx", self.shape, strict=True))
        first, second = [a for a in "zyx" if a != axis]
        if client and axis == "x":
            first, second = second, first
        rounding = "round" if client else "trunc"
        cut = self._bytes(slice_axis(self.rows, axis, index, sizes[axis]))
        if not (overlay and self.label):
            return cut.select(F.col(first).alias("row"), F.col(second).alias("col"), *[F.col("u8").alias(c) for c in "rgb"])
        joined = cut.join(palette(self.rows, self.label), self.label)
        alpha = F.lit(opacity) if not selected else F.when(F.col(self.label).isin(selected), opacity).otherwise(opacity * 0.15)
        mixed = [F.when(F.col(self.label) > 0, blend(F.col("u8").cast("double"), F.col(c).cast("double"), alpha, rounding)).otherwise(F.col("u8")).alias(c) for c in "rgb"]
        return joined.select(F.col(first).alias("row"), F.col(second).alias("col"), *mixed)

    def slice_png(self, axis: str, index: int, **options) -> DataFrame:
        """(rows, cols, png): the slice as the bytes of an RGBA image. One image is one task's; its pixels are all it gets."""
        sizes = dict(zip("zyx", self.shape, strict=True))
        first, second = [sizes[a] for a in "zyx" if a != axis]
        if options.get("client") and axis == "x":
            first, second = second, first

        def encode(pdf: pd.DataFrame) -> pd.DataFrame:
            image = np.zeros((first, second, 4), np.uint8)
            image[..., 3] = 255
            image[pdf["row"].to_numpy(), pdf["col"].to_numpy(), :3] = pdf[list("rgb")].to_numpy()
            return pd.DataFrame({"rows": [first], "cols": [second], "png": [png_bytes(image)]})

        return self.slice(axis, index, **options).groupBy().applyInPandas(encode, "rows int, cols int, png binary")

    def chunk(self, k: int) -> DataFrame:
        return self._bytes(downsample(self.rows, k)).select("z", "y", "x", "u8")

    def seg_chunk(self, k: int) -> DataFrame:
        """RGBA; label 0 is transparent."""
        out = downsample(self.rows, k).join(palette(self.rows, self.label), self.label)
        return out.select("z", "y", "x", "r", "g", "b", F.when(F.col(self.label) > 0, 255).otherwise(0).alias("a"))

    def seg_id_chunk(self, k: int) -> DataFrame:
        return downsample(self.rows, k).select("z", "y", "x", fold_id(F.col(self.label)).alias("seg_id"))

    def label_at(self, axis: str, index: int, row: int, col: int) -> DataFrame:
        return label_at(self.rows, axis, index, row, col, self.shape, self.label)

    def splat_points(self, label: int, stride: int = 1, mode: str = "surface", unit: float | None = None) -> DataFrame:
        """(px, py, pz) of every stride-th voxel of a label in raster order, in units of `unit` or else of the volume's longest side."""
        rows = surface(self.rows, self.shape, [], self.label) if mode == "surface" else self.rows.withColumn("surface", F.lit(True))
        kept = every_nth(rows.where(F.col("surface") & (F.col(self.label) == label)), stride, ["z", "y", "x"], [self.label])
        unit = unit or max(n * s for n, s in zip(self.shape, self.spacing, strict=True))
        sz, sy, sx = (s / unit for s in self.spacing)
        return kept.select(((F.col("x") + 0.5) * sx).alias("px"), ((F.col("y") + 0.5) * sy).alias("py"), ((F.col("z") + 0.5) * sz).alias("pz"))


class Catalog:
    """Volumes by id; each is also a temporary view of its rows."""

    def __init__(self):
        self._volumes: dict[str, Volume] = {}

    def register(self, volume: Volume, segmentation_shape: tuple[int, int, int] | None = None) -> Volume:
        if segmentation_shape is not None and tuple(segmentation_shape) != tuple(volume.shape):
            raise ValueError("raw and segmentation differ in shape")
        self._volumes[volume.volume_id] = volume
        volume.rows.createOrReplaceTempView(f"volume_{volume.volume_id}")
        return volume

    def __getitem__(self, volume_id: str) -> Volume:
        return self._volumes[volume_id]

    def ids(self) -> list[str]:
        return sorted(self._volumes)


def canvas_scale(canvas: tuple[float, float], extents: list[tuple[float, float]]) -> float:
    """One scale for all views: the largest at which every (width, height) in physical units fits the canvas."""
    return min(min(canvas[0] / w, canvas[1] / h) for w, h in extents)


def canvas_to_voxel(point: tuple[float, float], offset: tuple[float, float], scale: float, spacing: tuple[float, float], size: tuple[int, int]) -> tuple[int, int] | None:
    """The (row, col) under a canvas point, or None outside the slice. spacing and size are (row, col)."""
    col, row = ((point[0] - offset[0]) / (scale * spacing[1]), (point[1] - offset[1]) / (scale * spacing[0]))
    inside = 0 <= row < size[0] and 0 <= col < size[1]
    return (int(row), int(col)) if inside else None
