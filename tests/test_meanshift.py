"""Mean shift against a plain implementation: held modes and modes as a table, thousands of bins, groups."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lamella.operators import clustering, meanshift


def plain(x, bandwidth, iterations=300):
    """Flat-kernel mean shift with binned seeds: labels from 1."""
    bins = np.unique(np.rint(x / bandwidth), axis=0)
    modes, counts = (x.copy() if len(bins) == len(x) else bins * bandwidth), []
    for k in range(len(modes)):
        for step in range(iterations + 1):
            near = ((x - modes[k]) ** 2).sum(1) <= bandwidth**2
            if not near.any():
                break
            old, modes[k] = modes[k].copy(), x[near].mean(0)
            if np.linalg.norm(modes[k] - old) <= 1e-3 * bandwidth or step == iterations:
                break
        counts.append(near.sum())
    order = sorted((k for k in range(len(modes)) if counts[k]), key=lambda k: (-counts[k], *(-modes[k])))
    kept = []
    for k in order:
        if all(((modes[k] - modes[j]) ** 2).sum() > bandwidth**2 for j in kept):
            kept.append(k)
    if not kept:
        return np.ones(len(x), int)
    return ((x[:, None] - modes[kept][None]) ** 2).sum(-1).argmin(1) + 1


def frame(spark, x, groups=None):
    groups = [0] * len(x) if groups is None else groups
    return spark.createDataFrame([(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(groups, x, strict=True))], "lin long, g int, embedding array<double>").repartition(3)


def spread(seed, n, dims, centres=6):
    rng = np.random.default_rng(seed)
    c = rng.uniform(-8, 8, (centres, dims))
    return np.round(c[rng.integers(0, centres, n)] + rng.normal(0, 0.5, (n, dims)), 3)


@pytest.mark.parametrize(("held", "dims", "bandwidth"), [(1 << 20, 2, 1.5), (1 << 20, 4, 2.0), (0, 4, 2.0)])
def test_flat_clusters(spark, monkeypatch, held, dims, bandwidth):
    monkeypatch.setattr(meanshift, "CHUNK", 70)
    monkeypatch.setattr(meanshift, "BLOCK", 16)
    x = spread(dims, 300, dims)
    got = {r["lin"]: r["cluster"] for r in meanshift.flat_clusters(frame(spark, x), bandwidth, held=held).collect()}
    want = plain(x, bandwidth)
    assert [got[k] for k in range(len(x))] == want.tolist() and want.max() > 2


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_thousands_of_bins(spark, held):
    rng = np.random.default_rng(4)
    x = np.round(rng.integers(0, 60, (2000, 2)) + rng.normal(0, 0.02, (2000, 2)), 3)  # tight groups: few steps
    assert len(np.unique(np.rint(x / 0.4), axis=0)) > 1200
    got = {r["lin"]: r["cluster"] for r in meanshift.flat_clusters(frame(spark, x), 0.4, held=held).collect()}
    assert [got[k] for k in range(len(x))] == plain(x, 0.4).tolist()


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_groups_are_apart(spark, held):
    x = spread(7, 240, 3, 3)
    groups = np.arange(240) % 3
    rows = frame(spark, x, groups).unionByName(spark.createDataFrame([(999, 1, None), (998, None, [0.0] * 3)], "lin long, g int, embedding array<double>"))
    got = {r["lin"]: r["cluster"] for r in meanshift.flat_clusters(rows, 2.5, ["g"], held=held).collect()}
    for g in range(3):
        at = np.flatnonzero(groups == g)
        assert [got[k] for k in at] == plain(x[at], 2.5).tolist()
    assert got[999] == got[998] == 0 and len(got) == 242


def test_every_vector_in_its_own_bin_and_empty(spark):
    x = np.array([[0.0, 0.0], [0.9, 0.1], [5.0, 5.0], [-3.0, 2.0]])
    got = {r["lin"]: r["cluster"] for r in meanshift.flat_clusters(frame(spark, x), 0.5).collect()}
    assert [got[k] for k in range(4)] == plain(x, 0.5).tolist()
    assert meanshift.flat_clusters(frame(spark, x).limit(0), 0.5).count() == 0
    assert clustering.mean_shift(frame(spark, x), foreground="lin < 0").where("cluster <> 0").count() == 0


def test_classes_in_one_run_equal_classes_alone(spark):
    x = spread(9, 300, 3)
    groups = np.arange(300) % 4
    rows = frame(spark, x, groups)
    options = {"bandwidth": 1.0, "iterations": 4, "least": 5, "max_seeds": 20}
    got = {r["lin"]: r for r in clustering.soft_mean_shift(rows, by=["g"], **options)[0].collect()}
    for g in range(4):
        alone, modes = clustering.soft_mean_shift(rows.where(F.col("g") == g), **options)
        for r in alone.collect():
            assert (got[r["lin"]]["cluster"], got[r["lin"]]["share"]) == (r["cluster"], pytest.approx(r["share"]))
        assert isinstance(modes, pd.DataFrame) and len(modes) <= 20
    monkey = meanshift.soft_modes(rows, ["g"], 1.0, 4, 20, 0, "lin", "embedding", held=70)  # two batches of groups or more
    whole = meanshift.soft_modes(rows, ["g"], 1.0, 4, 20, 0, "lin", "embedding", held=1 << 20)
    assert np.allclose(np.stack(monkey["x"]), np.stack(whole["x"])) and monkey["g"].tolist() == whole["g"].tolist()
    ids = {r["lin"]: r["final_id"] for r in clustering.per_class_clusters(rows, "g", **options).collect()}
    pairs = sorted({(groups[k], got[k]["cluster"]) for k in range(300) if groups[k] > 0 and got[k]["cluster"] > 0})
    assert all(ids[k] == (pairs.index((groups[k], got[k]["cluster"])) + 1 if (groups[k], got[k]["cluster"]) in pairs else 0) for k in range(300))


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_nearest_centres(spark, held):
    x, c = spread(1, 200, 3), spread(2, 30, 3)
    rows = frame(spark, x, np.arange(200) % 3).unionByName(spark.createDataFrame([(900, 1, None)], "lin long, g int, embedding array<double>"))
    centres = spark.createDataFrame([(k % 2, 50 - k, v.tolist()) for k, v in enumerate(c)] + [(0, 51, c[0].tolist())], "g int, label int, mean array<double>")
    got = {r["lin"]: r for r in clustering.nearest_centres(rows, centres, ["g"], held=held).collect()}
    for k in range(200):
        own = [(((x[k] - c[j]) ** 2).sum(), 50 - j) for j in range(30) if j % 2 == k % 3]
        if k % 3 == 2:
            assert got[k]["nearest"] is None and got[k]["nearest_d"] is None
        else:
            assert got[k]["nearest"] == min(own)[1] and got[k]["nearest_d"] == pytest.approx(min(own)[0] ** 0.5)
    assert got[900]["nearest"] is None and len(got) == 201
