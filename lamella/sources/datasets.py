"""Named volume datasets as DataFrames: what each declares, which files it reads, how it splits and fuses labels.

A dataset gives voxel rows z, y, x, intensity (min-max scaled over the volume) and, where it has labels, label; with
optional extra label columns. Files are opened by Python data source tasks, one slab of sections each.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.scalar import minmax
from lamella.operators.selection import fuse_labels, stack_depth
from lamella.sources.formats import find_volume, format_of
from lamella.sources.volume_source import read_volume

ON = ["z", "y", "x"]


@dataclass(frozen=True)
class Info:
    """What a dataset has to declare. Resolution is in nanometres."""

    paper: str
    resolution: dict[str, float]
    labels: tuple[str, ...]
    data_files: dict[str, str] = field(default_factory=dict)

    def resolution_tuple(self) -> tuple[float, float, float]:
        r = self.resolution
        return r["z"], r["y"], r["x"]

    def anisotropy(self) -> float:
        r = self.resolution
        return r["z"] / ((r["x"] + r["y"]) / 2)


def whole_ids(rows: DataFrame, name: str = "label") -> DataFrame:
    """Ids as long; unsigned 64-bit ones stay decimal(20,0), as some don't fit (2**64 - 1 marks voxels without data)."""
    return rows if dict(rows.dtypes)[name].startswith("decimal") else rows.withColumn(name, F.col(name).cast("long"))


def scaled(rows: DataFrame, value: str = "value") -> DataFrame:
    """intensity: the value min-max scaled over the volume; a constant volume stays as it is."""
    rows = rows.withColumn(value, F.col(value).cast("double"))
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    out = rows.join(F.broadcast(ends), how="cross")
    return out.select(*ON, minmax(F.col(value), F.col("_lo"), F.col("_hi")).alias("intensity"))


class VolumeDataset(ABC):
    """A dataset: rows(spark, split) are its voxels."""

    info: Info

    def __init__(self, root: str):
        self.root = Path(root)

    @abstractmethod
    def rows(self, spark: SparkSession, split: str) -> DataFrame: ...

    def _file(self, base: str) -> str:
        found = find_volume(str(self.root), base, (".h5", ".hdf5", ".hdf", ".tiff", ".tif", ".nrrd", ".nhdr", ".npy", ".npz", ".nii.gz", ".nii"))
        if found is None:
            raise FileNotFoundError(f"{base} in {self.root}")
        return str(found)

    def _labels(self, spark: SparkSession, base: str, name: str = "label", key: str | None = None) -> DataFrame | None:
        try:
            path = self._file(base)
        except FileNotFoundError:
            return None
        return read_volume(spark, path, key).select(*ON, F.col("value").cast("decimal(20,0)").alias(name))

    def slices(self, spark: SparkSession, split: str) -> DataFrame:
        """One row a section: its index and the count of its voxels."""
        return self.rows(spark, split).groupBy(F.col("z").alias("slice_idx")).agg(F.count(F.lit(1)).alias("n"))


class Snemi3D(VolumeDataset):
    """AC4 for training and validation, AC3 for tests, whose labels may be missing."""

    info = Info("SNEMI3D", {"x": 6, "y": 6, "z": 30}, ("background", "neuron"), {"train": "AC4", "test": "AC3"})

    def rows(self, spark, split):
        base = self.info.data_files["test" if split == "test" else "train"]
        out = scaled(read_volume(spark, self._file(f"{base}_inputs")))
        labels = self._labels(spark, f"{base}_labels")
        return out.join(whole_ids(labels), ON, "left") if labels is not None else out


#: Datasets of a CREMI sample in one file, and the names such files have (fixed values).
CREMI_KEYS = {"raw": ("volumes/raw", "raw"), "neuron": ("volumes/labels/neuron_ids", "neuron_ids"), "cleft": ("volumes/labels/clefts", "clefts"), "mito": ("volumes/labels/mitochondria", "mitochondria")}
CREMI_FILES = ("sample_{}_20160501", "sample_{}+_20160601", "sample_{}_padded_20160501", "sample_{}", "{}/sample")


class Cremi3D(VolumeDataset):
    """Volumes one behind the other, with neuron, cleft and mitochondria ids fused by offsets; test is the validation tail.

    A sample is one file with a dataset for each of them, or a file for each (sample_A_raw, sample_A_neuron, ...).
    """

    info = Info("CREMI", {"x": 4, "y": 4, "z": 40}, ("background", "neuron", "cleft", "mitochondria"))

    def __init__(self, root: str, names: tuple[str, ...] = ("A", "B", "C"), train_share: float = 0.8):
        super().__init__(root)
        self.names, self.train_share = names, train_share

    def sample(self, name: str) -> dict[str, tuple[str, str | None]]:
        """The path and dataset of each part that the sample has; empty without an image."""
        for base in CREMI_FILES:
            try:
                path = self._file(base.format(name))
            except FileNotFoundError:
                continue
            there = format_of(path).datasets(path)
            found = {part: next(((path, k) for k in keys if k in there), None) for part, keys in CREMI_KEYS.items()}
            if found["raw"]:
                return {part: at for part, at in found.items() if at}
        out: dict[str, tuple[str, str | None]] = {}
        for part, files in {"raw": ("raw",), "neuron": ("neuron", "neuron_ids"), "cleft": ("cleft", "clefts"), "mito": ("mito", "mitochondria")}.items():
            for file in files:
                try:
                    out[part] = (self._file(f"sample_{name}_{file}"), None)
                    break
                except FileNotFoundError:
                    continue
        return out if "raw" in out else {}

    def rows(self, spark, split):
        parts, depths = [], []
        for name in self.names:
            at = self.sample(name)
            if not at:
                continue
            path, key = at["raw"]
            rows = scaled(read_volume(spark, path, key))
            none = spark.createDataFrame([], "z int, y int, x int, label decimal(20,0)")
            neuron, cleft, mito = (read_volume(spark, *at[part]).select(*ON, F.col("value").cast("decimal(20,0)").alias("label")) if part in at else none for part in ("neuron", "cleft", "mito"))
            fused = fuse_labels(rows.join(neuron, ON, "left"), cleft, mito, ON)
            parts.append(fused)
            depths.append(int(format_of(path).shape(path, key)[0]))
        if not parts:
            raise FileNotFoundError(f"no sample in {self.root}")
        out, edge = stack_depth(parts, depths), int(sum(depths) * self.train_share)
        return out.where(F.col("z") < edge) if split == "train" else out.where(F.col("z") >= edge)


class Microns(VolumeDataset):
    """A crop with segmentation and optional synapses and mitochondria; splits are ranges of sections."""

    info = Info("MICrONS", {"x": 4, "y": 4, "z": 40}, ("background", "neuron"))

    def __init__(self, root: str, valid_share: float = 0.2):
        super().__init__(root)
        self.valid_share = valid_share

    def rows(self, spark, split):
        path = self._file("volume")
        depth = int(format_of(path).shape(path)[0])
        edge = int(depth * (1 - self.valid_share))
        # Whole-volume scaling; the slab options keep other sections' label files unread.
        out = scaled(read_volume(spark, path))
        out = out if split == "test" else out.where(F.col("z") < edge) if split == "train" else out.where(F.col("z") >= edge)
        for base, name, needed in (("segmentation", "label", split != "test"), ("synapses", "synapses", False), ("mitochondria", "mitochondria", False)):
            extra = self._labels(spark, base, name)
            if extra is None and needed:
                raise FileNotFoundError(f"{base} in {self.root}")
            if extra is not None:
                out = out.join(whole_ids(extra, name), ON, "left")
        return out


class MitoEM2(VolumeDataset):
    """imagesTr/<case>_0000.nii.gz with labelsTr/<case>.nii.gz; the last cases are the validation split."""

    info = Info("MitoEM2", {"x": 8, "y": 8, "z": 8}, ("background", "mitochondria", "boundary"))

    def __init__(self, root: str, valid_share: float = 0.2):
        super().__init__(root)
        self.valid_share = valid_share

    def spacing(self) -> list[float]:
        meta = self.root / "dataset.json"
        return list(json.loads(meta.read_text()).get("spacing", [8.0, 8.0, 8.0])) if meta.exists() else [8.0, 8.0, 8.0]

    def cases(self, split: str) -> list[tuple[str, str | None]]:
        images = sorted((self.root / "imagesTr").glob("*_0000.nii.gz"))
        pairs = [(str(p), str(q) if (q := self.root / "labelsTr" / p.name.replace("_0000", "")).exists() else None) for p in images]
        edge = max(1, int(len(pairs) * (1 - self.valid_share)))
        return pairs if split == "test" else pairs[:edge] if split == "train" else pairs[edge:]

    @staticmethod
    def slice_axis(shape: tuple[int, ...]) -> int:
        """The last axis if it is shorter than the first, else the first."""
        return len(shape) - 1 if shape[-1] < shape[0] else 0

    def rows(self, spark, split):
        out = None
        for image, label in self.cases(split):
            one = scaled(read_volume(spark, image)).withColumn("case", F.lit(Path(image).name.replace("_0000.nii.gz", "")))
            if label:
                one = one.join(whole_ids(read_volume(spark, label).select(*ON, F.col("value").alias("label"))), ON, "left")
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError(f"no case for {split} in {self.root}")
        return out


def missing_files(spark: SparkSession, expected: list[str], root: str) -> DataFrame:
    """Expected files that are not there: an anti-join of the two listings."""
    want = spark.createDataFrame([(p,) for p in expected], "path string")
    have = spark.createDataFrame([(str(p.relative_to(root)),) for p in Path(root).rglob("*") if p.is_file()], "path string")
    return want.join(have, "path", "left_anti")


def evenly_spaced(size: int, n: int) -> list[int]:
    """n section indices from first to last."""
    return [round(k * (size - 1) / max(n - 1, 1)) for k in range(n)]
