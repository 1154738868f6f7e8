"""Patches by arithmetic and the sliding window over chunks against dense computations."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import tiling


@pytest.mark.parametrize("cover", ["full", "reference"])
def test_windows_equal_the_list_of_starts(spark, cover):
    cases = [(n, p, s) for n in (1, 5, 16, 17, 23) for p in (1, 4, 16) for s in (1, 3, 4, 7)]
    df = spark.createDataFrame([(n,) for n in sorted({c[0] for c in cases})], "n int")
    for p, s in product((1, 4, 16), (1, 3, 4, 7)):
        w = tiling.Windows(F.col("n"), p, s, cover)
        got = df.select("n", F.explode(w.every()).alias("k")).select("n", w.start(F.col("k")).alias("s")).collect()
        held = df.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("n", "x", w.covering(F.col("x"), F.col("x")).alias("k"), w.covering(F.col("x"), F.least(F.col("x") + 2, F.col("n") - 1)).alias("wide")).collect()
        for n in (1, 5, 16, 17, 23):
            starts = tiling.window_starts(n, p, s, cover)
            assert sorted(r["s"] for r in got if r["n"] == n) == starts
            for r in (r for r in held if r["n"] == n):
                assert r["k"] == [k for k, a in enumerate(starts) if a <= r["x"] < a + p]
                last = min(r["x"] + 2, n - 1)
                assert set(k for k, a in enumerate(starts) if a <= last and r["x"] < a + p) <= set(r["wide"])


def made():
    def model(block):  # a closure, so that workers need not import this file
        z, y, x = np.indices(block.shape)
        return {"logits": np.stack((block, 1 - block + y / 5, x / 7 - z)), "instance": np.stack((block + y, x - z * 1.0))}

    return model


def dense(volume, patch, stride, mode):
    bounds, sizes = volume.shape, [max(n, p) for n, p in zip(volume.shape, patch, strict=True)]
    wide = np.pad(volume, [(0, s - n) for s, n in zip(sizes, bounds, strict=True)], mode="reflect")
    weight, total, embed, mass = tiling.patch_weight(list(patch)), np.zeros((3, *sizes)), np.zeros((2, *sizes)), np.zeros(sizes)
    for corner in product(*[tiling.window_starts(n, p, s) for n, p, s in zip(bounds, patch, stride, strict=True)]):
        at = tuple(slice(a, a + p) for a, p in zip(corner, patch, strict=True))
        got = made()(wide[at])
        prob = np.exp(got["logits"]) / np.exp(got["logits"]).sum(0)
        here = (slice(None), *at)
        if mode == "max":
            embed[here] = np.where(prob.max(0) > total[here].max(0), got["instance"], embed[here])
            total[here] = np.maximum(total[here], prob)
        else:
            total[here] += prob * weight
            embed[here] += got["instance"] * weight
            mass[at] += weight
    if mode != "max":
        total, embed = total / (mass + 1e-8), embed / (mass + 1e-8)
    return total, embed


@pytest.mark.parametrize(("shape", "patch", "stride", "chunk", "mode"), [((7, 11, 13), (4, 6, 5), (2, 4, 5), (3, 4, 8), "gaussian"), ((7, 11, 13), (4, 6, 5), (2, 4, 5), (16, 16, 16), "max"), ((2, 9, 4), (5, 4, 8), (2, 2, 4), (2, 2, 2), "gaussian")])
def test_two_heads_over_chunks(spark, shape, patch, stride, chunk, mode):
    rng = np.random.default_rng(0)
    volumes = [rng.random(shape), rng.random(shape)]
    rows = [(s, *map(int, p), float(volumes[s][p])) for s in (0, 1) for p in np.ndindex(*shape)]
    df = spark.createDataFrame(rows, "sample_id int, z int, y int, x int, intensity double").repartition(4)
    d = {n: dict(zip("zyx", v, strict=True)) for n, v in {"shape": shape, "patch": patch, "stride": stride, "chunk": chunk}.items()}
    got = tiling.predict_patches(df, ["sample_id"], d["shape"], d["patch"], made(), d["stride"], mode=mode, chunk=d["chunk"]).collect()
    assert len(got) == len(rows)
    want = [dense(v, patch, stride, mode) for v in volumes]
    for r in got:
        p = (slice(None), r["z"], r["y"], r["x"])
        total, embed = want[r["sample_id"]]
        assert r["semantic"] == pytest.approx(total[p].tolist()) and r["instance"] == pytest.approx(embed[p].tolist())


def test_one_head_and_missing_voxels(spark):
    df = spark.createDataFrame([(0, 1, 1, 5.0)], "z int, y int, x int, intensity double")
    got = tiling.predict_patches(df, [], {"z": 1, "y": 3, "x": 3}, {"z": 1, "y": 2, "x": 2}, lambda b: np.stack((b, 0 * b)), mode="max")
    rows = {(r["y"], r["x"]): r for r in got.collect()}
    assert all(r["instance"] is None for r in rows.values()) and rows[1, 1]["semantic"][0] > 0.99 and rows[0, 0]["semantic"] == pytest.approx([0.5, 0.5])
    assert tiling.predict_patches(df.limit(0), [], {"z": 1, "y": 3, "x": 3}, {"z": 1, "y": 2, "x": 2}, lambda b: np.stack((b, 0 * b))).count() == 0


def test_grids_of_a_table_of_volumes(spark):
    volumes = spark.createDataFrame([(0, 1, 100, 50), (1, 5, 20, 33)], "sample_id int, nz int, ny int, nx int")
    patch = {"z": 2, "y": 32, "x": 32}
    for grid, starts in ((tiling.window_grid(volumes, patch, by=["sample_id"]), tiling.window_starts), (tiling.overlap_grid(volumes, patch, by=["sample_id"]), tiling.overlap_starts)):
        rows = grid.orderBy("sample_id", "patch_idx").collect()
        for v in volumes.collect():
            own = [r for r in rows if r["sample_id"] == v["sample_id"]]
            assert [(r["z0"], r["y0"], r["x0"]) for r in own] == list(product(*[starts(v[f"n{a}"], patch[a]) for a in "zyx"]))
            assert [r["patch_idx"] for r in own] == list(range(len(own)))


def test_patches_travel_as_arrow_and_keep_their_keys(spark):
    """No group is turned into pandas rows, and a volume without a name keeps its own."""
    df = spark.createDataFrame([(s, f"n{s}", 0, y, x, float(y + 10 * x)) for s in (None, 3) for y in range(5) for x in range(6)], "sample_id long, name string, z int, y int, x int, intensity double")
    shape, patch = {"z": 1, "y": 5, "x": 6}, {"z": 1, "y": 4, "x": 4}
    got = tiling.predict_patches(df, ["sample_id", "name"], shape, patch, made(), chunk={"y": 2, "x": 4})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("FlatMapGroupsInArrow") == 2
    rows = {(r["sample_id"], r["name"], r["y"], r["x"]): (r["semantic"], r["instance"]) for r in got.collect()}
    assert len(rows) == 60 and {k[:2] for k in rows} == {(None, "nNone"), (3, "n3")}
    assert all(v == rows[3, "n3", *k[2:]] for k, v in rows.items())
