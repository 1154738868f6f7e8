"""The volume browser: catalogue, steps, images; windows over a stream of labels."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import streaming
from lamella.operators import browser


def volume(spark, shape=(3, 4, 5), name="a"):
    rows = [(*map(int, p), float(np.ravel_multi_index(p, shape)), int(sum(p) % 3)) for p in np.ndindex(*shape)]
    return browser.Volume(name, spark.createDataFrame(rows, "z int, y int, x int, intensity double, label long"), shape, (4.0, 1.0, 1.0))


def test_catalogue(spark):
    catalogue = browser.Catalog()
    catalogue.register(volume(spark, name="b"), (3, 4, 5))
    catalogue.register(volume(spark))
    assert catalogue.ids() == ["a", "b"] and catalogue["b"].volume_id == "b"
    assert spark.sql("SELECT count(*) AS n FROM volume_a").first()["n"] == 60
    meta = catalogue["a"].meta().first()
    assert (meta["shape"], meta["has_seg"], meta["num_labels"]) == ([3, 4, 5], True, 3)
    with pytest.raises(ValueError, match="shape"):
        catalogue.register(volume(spark), (3, 4, 6))
    with pytest.raises(KeyError):
        catalogue["c"]


def test_steps_for_interactive_chunks():
    assert browser.downsample_choice((10, 400, 512)) == 1
    assert browser.downsample_choice((10, 400, 513)) == 2
    assert browser.downsample_choice((1000, 512, 512)) == 2  # 262 million voxels, 33 at every second one
    assert browser.downsample_choice((5, 100_000, 10)) == 16
    assert browser.downsample_choice((8, 8, 8), most_voxels=64) == 2


def decode(png):
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(png):
        n, name = struct.unpack(">I4s", png[at : at + 8])
        data = png[at + 8 : at + 8 + n]
        assert struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + data)
        parts[name] = data
        at += 12 + n
    cols, rows, depth, kind = struct.unpack(">2I2B", parts[b"IHDR"][:10])
    assert (depth, kind) == (8, 6)
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, 1 + 4 * cols)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(rows, cols, 4)


@pytest.mark.parametrize(("axis", "client", "shape"), [("z", False, (4, 5)), ("y", True, (3, 5)), ("x", False, (3, 4)), ("x", True, (4, 3))])
def test_slice_images(spark, axis, client, shape):
    v = volume(spark)
    row = v.slice_png(axis, 1, selected=[2], client=client).first()
    image = decode(bytes(row["png"]))
    assert image.shape[:2] == shape == (row["rows"], row["cols"]) and (image[..., 3] == 255).all()
    for r in v.slice(axis, 1, selected=[2], client=client).collect():
        assert image[r["row"], r["col"], :3].tolist() == [r["r"], r["g"], r["b"]]
    if axis == "x":
        plain = decode(bytes(v.slice_png("x", 1, overlay=False).first()["png"]))
        turned = decode(bytes(v.slice_png("x", 1, overlay=False, client=True).first()["png"]))
        assert (plain.transpose(1, 0, 2) == turned).all()


def test_sizes_by_window(spark, tmp_path):
    rows = [(1, "2024-01-01 00:01:00"), (1, "2024-01-01 00:09:00"), (2, "2024-01-01 00:09:30"), (1, "2024-01-01 00:11:00")]
    spark.createDataFrame(rows, "label int, t string").select("label", F.to_timestamp("t").alias("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("label int, t timestamp").parquet(str(tmp_path / "in"))
    query = streaming.streaming_sizes(stream, "label", "t").writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = {(r["window"]["start"].minute, r["label"]): r["size"] for r in spark.table("sizes").collect()}
    assert got == {(0, 1): 2, (0, 2): 1, (10, 1): 1}
