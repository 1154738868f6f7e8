"""Slabs of packed files: only the bytes that hold them are read."""

import gzip

import numpy as np
import pytest

from lamella.sources import streams
from lamella.sources.formats import Nifti, Nrrd, format_of
from lamella.sources.volume_source import read_volume


def test_blocked_bytes_are_gzip_and_read_by_range(tmp_path):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes() + b"a" * 300_000
    packed = streams.blocked(data)
    assert gzip.decompress(packed) == data and gzip.decompress(streams.blocked(b"")) == b""
    for name, body in (("blocked", packed), ("plain", gzip.compress(data)), ("members", gzip.compress(data[:90_000]) + gzip.compress(data[90_000:]))):
        path = tmp_path / name
        path.write_bytes(b"head" + body)
        for a, b in ((0, 10), (65_000, 66_000), (399_990, 400_020), (123_456, 323_456), (699_990, 800_000), (0, len(data)), (5, 5)):
            got = streams.Bytes(path, 4)
            assert got.read(a, b) == data[a:b]
            if name == "blocked" and b > a:
                assert got.inflated <= min(b, len(data)) - a + 2 * streams.BLOCK and got.taken <= got.inflated * 1.01 + 22 * 13 + 64
            assert got.inflated <= b + 2 * streams.PIECE


def test_slabs_read_a_share_of_the_file(tmp_path):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 60_000, (40, 100, 120)).astype(np.uint16)
    whole = data.nbytes
    for fmt, name, slices in ((Nrrd(), "v.nrrd", (slice(10, 14), slice(3, 50), slice(None))), (Nifti(), "v.nii.gz", (slice(1, 30), slice(None), slice(60, 66))), (Nifti(), "v.nii", (slice(1, 30), slice(None), slice(60, 66)))):
        path = str(tmp_path / name)
        fmt.save(data, path)
        got, body = fmt.slab(path, slices)
        assert (got == data[slices]).all() and (fmt.load(path) == data).all() and (fmt.load_slab(path, slices) == data[slices]).all()
        assert body.taken < whole / 4 and body.inflated < whole / 3
        assert fmt.metadata(path)["shape"] == [40, 100, 120]


@pytest.mark.parametrize("name", ["v.nrrd", "v.nii.gz", "v.npy"])
def test_source_reads_every_voxel_once(spark, tmp_path, name):
    data = np.arange(5 * 6 * 7).reshape(5, 6, 7).astype(np.int32)
    path = str(tmp_path / name)
    format_of(path).save(data, path)
    rows = read_volume(spark, path, slab=2)
    got = {(r["z"], r["y"], r["x"]): r["value"] for r in rows.collect()}
    assert got == {p: int(data[p]) for p in np.ndindex(*data.shape)} and rows.rdd.getNumPartitions() > 1
    some = {(r["z"], r["y"], r["x"]): r["value"] for r in read_volume(spark, path, slab=2, z=(1, 4)).collect()}
    assert some == {p: v for p, v in got.items() if 1 <= p[0] < 4}
    assert read_volume(spark, path, z=(9, 12)).count() == 0


def test_ids_beyond_long_stay_whole(spark):
    from lamella.sources.datasets import whole_ids

    rows = spark.createDataFrame([(1,)], "x int").selectExpr("cast('18446744073709551615' as decimal(20,0)) as label", "x as other")
    assert int(whole_ids(rows).first()["label"]) == 2**64 - 1 and dict(whole_ids(rows, "other").dtypes)["other"] == "bigint"
