"""Blocks that leave short axes whole, and passes by planes, give what small blocks and lines give."""

import numpy as np
import pytest

from lamella.operators import blocks, geometry, lines, losses


def test_sides_leave_short_axes_whole():
    assert blocks.block_sides("zyx", {"z": 10_000, "y": 100, "x": 50}, 32, 5 << 17) == {"z": 67}
    assert blocks.block_sides("yx", {"y": 100, "x": 50}, 16, 1 << 17) == {}
    assert blocks.block_sides("zyx", dict.fromkeys("zyx", 5000), 16, 80**3) == dict.fromkeys("zyx", 48)
    for shape in ((1000, 100, 100), (3, 4000, 4000), (200, 200, 200)):
        sides = blocks.block_sides("zyx", dict(zip("zyx", shape, strict=True)), 8, 1 << 18)
        assert np.prod([sides[a] + 16 if a in sides else n for a, n in zip("zyx", shape, strict=True)]) <= 1 << 18
    assert lines.planes("zyx", {"z": 10_000, "y": 100, "x": 50}) == ["yx", "z"] and lines.planes("yx", {"y": 5000, "x": 5000}) == ["x", "y"]


def rows_of(spark, shape):
    labels = np.random.default_rng(5).choice([0, 1, 1, 1, 2, 2], shape)
    rows = [(0, *map(int, p), int(np.ravel_multi_index(p, shape)), int(labels[p])) for p in np.ndindex(*shape)]
    names = "zyx"[3 - len(shape) :]
    return spark.createDataFrame(rows, ", ".join(["sample_id int", *(f"{a} int" for a in names), "lin long", "label long"])).repartition(4), dict(zip(names, shape, strict=True)), names


@pytest.mark.parametrize("shape", [(60, 7), (40, 6, 5)])
def test_small_blocks_and_lines_change_nothing(spark, monkeypatch, shape):
    rows, sizes, axes = rows_of(spark, shape)
    calls = []
    settled = geometry.settled
    monkeypatch.setattr(geometry, "settled", lambda df: calls.append(1) or settled(df))

    def got():
        return {r["lin"]: r for r in geometry.skeleton_targets(rows, ["sample_id"], sizes, axes=axes).collect()}

    whole = got()
    assert len(calls) == 1  # one block: no exchange of halos
    monkeypatch.setattr(lines, "PLANE", 1)
    monkeypatch.setattr(geometry, "HALO", {2: 4, 3: 8})
    monkeypatch.setattr(geometry, "THINNED", {2: 16 * 7, 3: 24 * 30})
    monkeypatch.setattr(geometry, "SEARCHED", {2: 20 * 7, 3: 20 * 30})
    cut = got()
    assert len(calls) > 2 and cut == whole


def test_loss_averages_samples_without_a_join_by_voxel(spark):
    """Where offsets land is sampled and averaged for itself, so the plan joins voxels with the field only."""
    rows, sizes, axes = rows_of(spark, (20, 6))
    t = geometry.skeleton_targets(rows, ["sample_id"], sizes, axes=axes)
    given = t.withColumns({"oy": (t["ny"] - t["y"]) / 2, "ox": (t["nx"] - t["x"]) / 2})
    got = losses.skeleton_embedding_loss(given, ["sample_id"], field=t)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "lin#" in line]
    assert not joins
    field, want = {(r["y"], r["x"]): r["dt_norm"] for r in t.collect()}, []
    for r in given.collect():
        y, x = r["y"] + r["oy"], r["x"] + r["ox"]
        y0, x0 = int(np.floor(y)), int(np.floor(x))
        want.append(1 - sum((1 - abs(y - a)) * (1 - abs(x - b)) * field.get((a, b), 0.0) for a in (y0, y0 + 1) for b in (x0, x0 + 1)))
    assert got.first()["benefit"] == pytest.approx(np.mean(want))
