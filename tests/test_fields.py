"""Fields, components of colour and indicator volumes against direct computations."""

import numpy as np
import pytest

from lamella import session
from lamella.operators import geometry, prompts


def block(spark, mask):
    rows = [(0, 0, int(y), int(x), int(mask[y, x]), int(y * mask.shape[1] + x)) for y, x in np.ndindex(*mask.shape)]
    return spark.createDataFrame(rows, "sample_id int, z int, y int, x int, label long, lin long")


def test_skeleton_targets_point_to_the_nearest_skeleton_voxel(spark):
    mask = np.zeros((12, 16), int)
    mask[2:9, 2:13] = 1
    mask[5:10, 9:14] = 1
    rows, shape = block(spark, mask), {"y": 12, "x": 16}
    line = {(r["y"], r["x"]) for r in geometry.skeletons(rows, ["sample_id"], shape).collect()}
    got = geometry.skeleton_targets(rows, ["sample_id"], shape).collect()
    assert len(got) == mask.sum() and line and line <= {tuple(p) for p in np.argwhere(mask)}
    outside = np.argwhere(mask == 0)
    dt = np.array([[np.sqrt(((outside - (y, x)) ** 2).sum(1).min()) for x in range(16)] for y in range(12)])
    for r in got:
        own = np.array([r["y"], r["x"]])
        assert (r["ny"], r["nx"]) in line
        gap = np.array([r["ny"], r["nx"]]) - own
        assert (gap**2).sum() == min(((np.array(p) - own) ** 2).sum() for p in line)
        size = np.sqrt((gap**2).sum())
        assert [r["sy"], r["sx"]] == pytest.approx(list(gap / size if size else gap))
        assert r["dt_norm"] == pytest.approx(dt[r["y"], r["x"]] / (dt * mask).max())


def test_structure_tensor_follows_a_bar(spark):
    mask = np.zeros((9, 60), int)
    mask[3:6, 5:55] = 1
    got = geometry.structure_tensor(block(spark, mask), ["sample_id"], {"y": 9, "x": 60}, sigma=2.0).collect()
    assert len(got) == mask.sum()
    for r in got:
        t = np.array(r["tensor"]).reshape(2, 2)
        assert np.allclose(t, t.T) and np.linalg.eigvalsh(t).min() > -1e-9
        if 20 <= r["x"] < 40 and r["y"] != 4:  # beside the axis: the gradient runs across the bar, along y
            assert t[1, 1] > 2 * t[0, 0]


def test_pca_rgb_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) * [5, 3, 2, 0.5, 0.1]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "lin long, embedding array<double>").repartition(4)
    got = np.array([[r["r"], r["g"], r["b"]] for r in sorted(geometry.pca_rgb(frame).collect(), key=lambda r: r["lin"])])
    main = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:3]
    main = main * np.sign(main[np.arange(3), np.abs(main).argmax(1)])[:, None]
    p = (x - x.mean(0)) @ main.T
    assert np.allclose(got, (p - p.min(0)) / np.ptp(p, axis=0))
    assert geometry.pca_rgb(frame.limit(0)).count() == 0


def test_indicator_volume_channels(spark):
    schema = "sample_id int, polarity string, z int, y int, x int, target_sem int, target_inst long"
    points = spark.createDataFrame([(0, "pos", 0, 1, 2, 1, 7), (0, "neg", 0, 3, 4, 1, 7), (0, "pos", 0, 1, 2, 1, 7), (1, "pos", 0, 0, 0, 9, 0)], schema)
    got = {(r["sample_id"], r["channel"], r["y"], r["x"], r["value"]) for r in prompts.indicator_volume(points, ["sample_id"], 3).collect()}
    assert got == {(0, 0, 1, 2, 1.0), (0, 1, 3, 4, 1.0), (0, 3, 1, 2, 1.0), (0, 3, 3, 4, 1.0), (0, 5, 1, 2, 1.0), (1, 0, 0, 0, 1.0)}


def test_a_cluster_has_to_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
