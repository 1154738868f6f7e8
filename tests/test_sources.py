import gzip
import importlib.util

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.sources import formats, volume_source


@pytest.mark.parametrize("name, dtype", [("a.npy", "f4"), ("a.npz", "f4"), ("a.nrrd", "f4"), ("a.nii", "f4"), ("a.nii.gz", "i2"), ("a.tiff", "u1"), ("a.tif", "u2")])
def test_round_trip(tmp_path, name, dtype):
    data = (np.random.default_rng(1).random((5, 16, 12)) * 100).astype(dtype)
    path = str(tmp_path / "deep" / name)
    formats.save_volume(data, path)
    assert np.array_equal(formats.load_volume(path), data)
    fmt = formats.format_of(path)
    assert fmt.shape(path) == (5, 16, 12) and fmt.validate(path)
    assert np.array_equal(fmt.load_slab(path, (slice(1, 3), slice(0, 4), slice(2, 5))), data[1:3, 0:4, 2:5])


def test_errors_and_priority(tmp_path):
    with pytest.raises(ValueError, match="Unsupported format"):
        formats.load_volume(str(tmp_path / "volume.xyz"))
    with pytest.raises(FileNotFoundError):
        formats.load_volume(str(tmp_path / "none.npy"))
    (tmp_path / "data.h5").touch()
    (tmp_path / "data.tiff").touch()
    assert formats.find_volume(str(tmp_path), "data").name == "data.h5"
    assert formats.find_volume(str(tmp_path), "other") is None
    assert not formats.Nrrd().validate(str(tmp_path / "data.h5"))
    with pytest.raises(ValueError):
        formats.as_volume(np.zeros((2, 2)))
    assert formats.as_volume(np.zeros((1, 2, 3, 4))).shape == (2, 3, 4)


def test_spacing(tmp_path):
    path = str(tmp_path / "s.nrrd")
    formats.Nrrd().save(np.zeros((4, 3, 2), "u1"), path, spacing=(30.0, 6.0, 6.0))
    assert formats.Nrrd().spacing(path) == [6.0, 6.0, 30.0]
    assert formats.spacing_of(path, (5.0,)) == (1.0, 1.0, 5.0)
    affine = np.diag([2.0, 3.0, 4.0, 1.0])
    formats.Nifti().save(np.zeros((3, 4, 5), "f4"), str(tmp_path / "a.nii.gz"), affine=affine)
    data, got = formats.Nifti().load_with_affine(str(tmp_path / "a.nii.gz"))
    assert np.allclose(got, affine) and formats.spacing_of(str(tmp_path / "a.nii.gz")) == (2.0, 3.0, 4.0)
    assert gzip.decompress((tmp_path / "a.nii.gz").read_bytes())[344:347] == b"n+1"


@pytest.mark.skipif(importlib.util.find_spec("h5py") is None, reason="h5py is not installed")
def test_hdf5(tmp_path):
    path = str(tmp_path / "a.h5")
    formats.save_volume(np.arange(20.0).reshape(4, 5), path)
    assert formats.load_volume(path).shape == (4, 5)


def test_volume_source(spark, tmp_path):
    data = np.arange(4 * 5 * 6, dtype="f8").reshape(4, 5, 6)
    path = str(tmp_path / "v.npy")
    formats.save_volume(data, path)
    rows = volume_source.read_volume(spark, path, slab=2)
    assert rows.count() == data.size and rows.rdd.getNumPartitions() == 2
    pruned = volume_source.read_volume(spark, path, slab=1, z=(1, 3))
    assert pruned.rdd.getNumPartitions() == 2
    row = pruned.agg(F.sum("value").alias("s"), F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    assert (row["s"], row["lo"], row["hi"]) == (data[1:3].sum(), 1, 2)
    blocks = volume_source.to_blocks(rows, (2, 3, 4))
    back = volume_source.from_blocks(blocks, (2, 3, 4))
    assert back.exceptAll(rows).count() == 0 and back.count() == data.size
    rows.write.format("volume").mode("overwrite").save(str(tmp_path / "out"))
    parts = [np.load(p) for p in sorted((tmp_path / "out").glob("part-*.npz"))]
    assert sum(len(p["value"]) for p in parts) == data.size
    assert volume_source.volume_catalog(spark, [path]).first()["shape"] == [4, 5, 6]


def test_pairing(spark):
    images = spark.createDataFrame([("a_0000.nii.gz", "i/a"), ("b_0000.nii.gz", "i/b")], "name string, path string")
    labels = spark.createDataFrame([("a.nii.gz", "l/a")], "name string, path string")
    got = volume_source.pair_files(images, labels).collect()
    assert [r["label_path"] for r in got] == ["l/a", None]


def test_streaming_contingency(spark, tmp_path):
    from lamella.streaming import streaming_contingency

    rows = spark.createDataFrame([(1, 1, "2024-01-01 00:00:01"), (1, 1, "2024-01-01 00:00:02"), (2, 1, "2024-01-01 00:11:00")], "p int, g int, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming_contingency(stream, "p", "g", "t").writeStream.format("memory").queryName("cont").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["nij"] for r in spark.table("cont").collect()) == [1, 2]


def test_large_ids_keep_their_digits(spark, tmp_path):
    ids = np.array([[[864691135341200001, 864691135341200002], [0, 2**53 + 1]]], np.int64)
    wide = np.array([[[2**64 - 1, 2**63], [2**64 - 2, 5]]], np.uint64)
    for name, data, kind in (("a", ids, "bigint"), ("b", wide, "decimal(20,0)")):
        formats.save_volume(data, str(tmp_path / f"{name}.npy"))
        rows = volume_source.read_volume(spark, str(tmp_path / f"{name}.npy"))
        assert dict(rows.dtypes)["value"] == kind
        assert [int(r["value"]) for r in rows.orderBy("z", "y", "x").collect()] == data.ravel().tolist()
        rows.write.format("volume").mode("overwrite").save(str(tmp_path / f"out-{name}"))
        parts = [np.load(p) for p in (tmp_path / f"out-{name}").glob("part-*.npz")]
        assert {int(v) for p in parts for v in p["value"]} == set(data.ravel().tolist())
        assert all(p["value"].dtype.kind in "iu" for p in parts)
