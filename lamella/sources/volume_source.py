"""Spark data source `volume`: voxel rows of array files, one input partition for a slab of sections.

    spark.dataSource.register(VolumeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("volume").option("slab", 16).load(path)      # z, y, x, value
    df.write.format("volume").option("shape", "4,8,8").mode("overwrite").save(folder)

A slab is a range of the axis along which the file is laid out (the first one; of NIfTI the last), so that it is one range
of bytes, and of a blocked gzip file only the members that hold it are inflated. The options z0 and z1 (half-open) keep a
range of the first axis, where that is the file's axis before anything is read; they are options and not pushed filters,
since a session keeps a pushed reader for later scans of the same relation. Executors open the path themselves: it
has to be on storage that all of them mount.

The value's type follows the file's: whole numbers are long, unsigned 64-bit ones decimal(20,0), so that ids keep all
their digits; all else is double. Writing keeps whole numbers whole in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from lamella.sources.formats import format_of



def value_type(path: str, key: str | None = None) -> pa.DataType:
    """The type of a file's values as Spark reads them, from its header."""
    dtype = format_of(path).dtype(path, key)
    if dtype == np.uint64:
        return pa.decimal128(20, 0)
    return pa.int64() if dtype.kind in "iub" else pa.float64()


def whole(values: list) -> np.ndarray:
    """Values of a column as an array: whole numbers as int64, or uint64 where one needs it; all else as float64."""
    if all(isinstance(v, int) or isinstance(v, Decimal) and v == v.to_integral_value() for v in values):
        numbers = [int(v) for v in values]
        return np.array(numbers, np.uint64 if numbers and max(numbers) >= 1 << 63 else np.int64)
    return np.array(values, np.float64)


@dataclass
class Slab(InputPartition):
    first: int
    last: int


class VolumeReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.key, self.slab = options.get("path"), options.get("key"), int(options.get("slab", "16"))
        shape = format_of(self.path).shape(self.path, self.key)
        self.shape = tuple(shape) if len(shape) == 3 else (1, *shape) if len(shape) == 2 else tuple(shape)
        self.flat = len(shape) == 2
        self.type = value_type(self.path, self.key)
        self.low = max(0, int(options.get("z0", "0")))
        self.high = min(self.shape[0], int(options.get("z1", str(self.shape[0]))))
        self.axis = 0 if self.flat else format_of(self.path).slow_axis % 3

    def partitions(self):
        low, high = (self.low, self.high) if self.axis == 0 else (0, self.shape[self.axis] if self.low < self.high else 0)
        return [Slab(a, min(a + self.slab, high)) for a in range(low, high, self.slab)] or [Slab(0, 0)]

    def read(self, partition: Slab):
        if partition.first >= partition.last:
            return
        if self.flat:
            data = format_of(self.path).load(self.path, self.key)[None]
        else:
            ranges = [slice(self.low, self.high), slice(None), slice(None)]
            ranges[self.axis] = slice(partition.first, partition.last)
            data = format_of(self.path).load_slab(self.path, tuple(ranges), self.key)
        base = [self.low, 0, 0]
        base[self.axis] = partition.first
        z, y, x = (c.ravel().astype(np.int32) for c in np.indices(data.shape))
        flat = np.ascontiguousarray(data).ravel()
        if pa.types.is_decimal(self.type):
            values = pa.array(flat.astype(np.uint64)).cast(self.type)
        else:
            values = pa.array(flat.astype(self.type.to_pandas_dtype()))
        yield pa.RecordBatch.from_arrays([*(pa.array(c + np.int32(b)) for c, b in zip((z, y, x), base, strict=True)), values], names=["z", "y", "x", "value"])


@dataclass
class Written(WriterCommitMessage):
    path: str


class VolumeWriter(DataSourceWriter):
    """Each task writes its voxels as one npz of coordinates and values: part-<task>.npz."""

    def __init__(self, options):
        self.path = options.get("path")

    def write(self, rows):
        import uuid
        from pathlib import Path

        from pyspark import TaskContext

        own = [(r["z"], r["y"], r["x"], r["value"]) for r in rows]
        Path(self.path).mkdir(parents=True, exist_ok=True)
        name = f"{self.path}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.npz"
        np.savez_compressed(name, at=np.array([r[:3] for r in own], np.int32).reshape(-1, 3), value=whole([r[3] for r in own]))
        return Written(name)

    def commit(self, messages):
        from pathlib import Path

        kept = {Path(m.path).name for m in messages if m}
        for p in Path(self.path).glob("part-*.npz"):
            if p.name not in kept:
                p.unlink()

    def abort(self, messages):
        from pathlib import Path

        for m in messages:
            if m:
                Path(m.path).unlink(missing_ok=True)


class VolumeSource(DataSource):
    @classmethod
    def name(cls):
        return "volume"

    def schema(self):
        kind = value_type(self.options["path"], self.options.get("key"))
        return "z int, y int, x int, value " + ("decimal(20,0)" if pa.types.is_decimal(kind) else "long" if pa.types.is_integer(kind) else "double")

    def reader(self, schema):
        return VolumeReader(self.options)

    def writer(self, schema, overwrite):
        return VolumeWriter(self.options)


def read_volume(spark: SparkSession, path: str, key: str | None = None, slab: int = 16, z: tuple[int, int] | None = None) -> DataFrame:
    format_of(path)
    spark.dataSource.register(VolumeSource)
    reader = spark.read.format("volume").option("slab", slab)
    if z:
        reader = reader.option("z0", z[0]).option("z1", z[1])
    return (reader.option("key", key) if key else reader).load(path)


def volume_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, format, shape, dtype, spacing, attrs) from headers only."""
    from lamella.sources.formats import spacing_of

    rows = []
    for p in paths:
        meta = format_of(p).metadata(p)
        rows.append((p, type(format_of(p)).__name__.lower(), list(meta["shape"]), str(meta["dtype"]), list(spacing_of(p)), {k: str(v) for k, v in (meta.get("attrs") or {}).items()}))
    return spark.createDataFrame(rows, "path string, format string, shape array<int>, dtype string, spacing array<double>, attrs map<string,string>")


def pair_files(images: DataFrame, labels: DataFrame, suffix: str = "_0000") -> DataFrame:
    """Left join of image and label listings (column name) on the image's name without the channel suffix."""
    named = images.withColumn("case", F.regexp_replace("name", suffix, ""))
    return named.join(labels.select(F.col("name").alias("case"), F.col("path").alias("label_path")), "case", "left").orderBy("case")


def to_blocks(rows: DataFrame, block: tuple[int, int, int], value: str = "value") -> DataFrame:
    """(bz, by, bx, n, at, data): voxel rows as chunks, values in the order of at (the place in the block)."""
    bd, bh, bw = block
    keys = rows.select(F.expr(f"z div {bd}").alias("bz"), F.expr(f"y div {bh}").alias("by"), F.expr(f"x div {bw}").alias("bx"), (((F.col("z") % bd) * bh + F.col("y") % bh) * bw + F.col("x") % bw).alias("at"), F.col(value).alias("v"))
    packed = keys.groupBy("bz", "by", "bx").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("c"))  # a block's volume at most
    return packed.select("bz", "by", "bx", F.size("c").alias("n"), F.transform("c", lambda c: c["at"]).alias("at"), F.transform("c", lambda c: c["v"]).alias("data"))


def from_blocks(blocks: DataFrame, block: tuple[int, int, int]) -> DataFrame:
    bd, bh, bw = block
    cells = blocks.select("bz", "by", "bx", F.explode(F.arrays_zip("at", "data")).alias("c"))
    at = F.col("c.at")
    place = {"z": F.col("bz") * bd + F.floor(at / (bh * bw)), "y": F.col("by") * bh + F.floor(at / bw) % bh, "x": F.col("bx") * bw + at % bw}
    return cells.select(*[v.cast("int").alias(k) for k, v in place.items()], F.col("c.data").alias("value"))
