"""Fields by lines and by blocks with halos: equal to dense computations in two and three dimensions, at every block size."""

from itertools import product

import numpy as np
import pytest

from lamella.operators import geometry, lines

AXES = {2: "yx", 3: "zyx"}


def frame(spark, labels, dense=True, parts=3):
    places = [p for p in np.ndindex(*labels.shape) if dense or labels[p]]
    dims = labels.ndim
    rows = [(7, *(map(int, p if dims == 3 else (0, *p))), int(labels[p]), int(np.ravel_multi_index(p, labels.shape)), "x") for p in places]
    return spark.createDataFrame(rows, "sample_id int, z int, y int, x int, label long, lin long, extra string").repartition(parts)


def shape_of(labels):
    return dict(zip(AXES[labels.ndim], labels.shape, strict=True))


def volume(seed, shape, names=4):
    """Blobs of several labels that touch, holes and single voxels."""
    rng = np.random.default_rng(seed)
    out = np.zeros(shape, int)
    for k in range(1, names + 1):
        for _ in range(3):
            low = [rng.integers(0, n) for n in shape]
            high = [min(n, a + rng.integers(1, max(2, n // 2))) for a, n in zip(low, shape, strict=True)]
            out[tuple(slice(a, b) for a, b in zip(low, high, strict=True))] = k
    out[rng.random(shape) < 0.05] = 0
    return out


def dense_dt(mask):
    inside, outside = np.argwhere(mask), np.argwhere(~mask)
    out = np.zeros(mask.shape)
    for a in range(0, len(inside), 200):
        out[tuple(inside[a : a + 200].T)] = np.sqrt(((inside[a : a + 200, None] - outside[None]) ** 2).sum(-1).min(1))
    return out


def by_place(rows, axes, name):
    return {tuple(r[a] for a in axes): r[name] for r in rows}


@pytest.mark.parametrize("shape", [(23, 31), (9, 14, 11), (1, 40), (6, 1, 9)])
def test_distances_and_gradients(spark, shape, monkeypatch):
    monkeypatch.setattr(lines, "STEP_ROWS", 64)
    labels, axes = volume(len(shape), shape), AXES[len(shape)]
    for dense in (True, False):
        dt = geometry.distance_transform(frame(spark, labels, dense), ["sample_id"], shape_of(labels), axes=axes)
        got = geometry.distance_gradient(dt, ["sample_id"], shape_of(labels), axes=axes).collect()
        assert len(got) == (labels > 0).sum()
        for name in np.unique(labels[labels > 0]):
            want = dense_dt(labels == name)
            slope = [np.gradient(want, axis=k) if n > 1 else np.zeros(shape) for k, n in enumerate(shape)]
            for r in (r for r in got if r["label"] == name):
                p = tuple(r[a] for a in axes)
                assert r["dt"] == want[p] and r["dt_norm"] == pytest.approx(want[p] / want.max())
                assert [r[f"g{a}"] for a in axes] == pytest.approx([g[p] for g in slope])


def test_full_volume_and_nothing(spark):
    rows = frame(spark, np.ones((3, 4), int))
    got = geometry.distance_transform(rows, ["sample_id"], {"y": 3, "x": 4}).collect()
    assert len(got) == 12 and all(r["dt"] is None and r["dt_norm"] == 0 for r in got)
    empty = frame(spark, np.zeros((3, 4), int))
    for fn in (geometry.distance_transform, geometry.skeletons, geometry.skeleton_targets, geometry.structure_tensor):
        assert fn(empty, ["sample_id"], {"y": 3, "x": 4}).count() == 0


def test_lower_envelope_of_many_stretches():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 40, rng.integers(1, 6))
        height = rng.choice([0, 1, 4, 9, lines.FAR, 25, 2], sizes.sum()).astype(float)
        stop = np.cumsum(sizes)
        got = lines.lower_envelope(height, stop - sizes, stop)
        for a, b in zip(stop - sizes, stop, strict=True):
            q = np.arange(a, b)
            assert (got[a:b] == ((q[:, None] - q[None]) ** 2.0 + height[None, a:b]).min(1)).all()


def pieces(cells, full):
    cells, out = set(cells), []
    while cells:
        todo, own = [cells.pop()], set()
        while todo:
            c = todo.pop()
            own.add(c)
            for d in product((-1, 0, 1), repeat=len(c)):
                n = tuple(a + b for a, b in zip(c, d, strict=True))
                if n in cells and (full or sum(map(abs, d)) == 1):
                    cells.remove(n)
                    todo.append(n)
        out.append(own)
    return out


@pytest.mark.parametrize("dims", [2, 3])
def test_simple_voxels_by_definition(dims):
    around, *_ = geometry._neighbours(dims)
    rng = np.random.default_rng(1)
    keys = np.arange(256) if dims == 2 else rng.integers(0, 1 << 26, 400) & rng.integers(0, 1 << 26, 400)
    got = geometry.simple(keys.astype(np.int64), dims)
    for key, ok in zip(keys.tolist(), got, strict=True):
        fg = {o for k, o in enumerate(around) if key >> k & 1}
        bg = {o for o in around if o not in fg and sum(map(abs, o)) <= 2}
        touching = [p for p in pieces(bg, False) if any(sum(map(abs, c)) == 1 for c in p)]
        assert ok == (len(pieces(fg, True)) == 1 and len(touching) == 1)


def euler(mask):
    """Euler number of the union of closed voxels."""
    wide = np.pad(mask, 1)
    total = 0
    for cell in product((0, 1), repeat=mask.ndim):  # axes along which the cell of the complex is flat
        on = np.zeros([n - 1 for n in wide.shape], bool)
        for o in product(*[(0, 1) if c else (0,) for c in cell]):
            on |= wide[tuple(slice(a, a + n - 1) for a, n in zip(o, wide.shape, strict=True))]
        total += (-1) ** (mask.ndim - sum(cell)) * int(on.sum())
    return total


@pytest.mark.parametrize("shape", [(40, 36), (14, 18, 16)])
def test_thinning_keeps_the_topology(shape):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        mask = volume(seed, shape) > 0
        mask &= rng.random(shape) < 0.97
        thin = geometry.skeletonize(mask)
        assert thin.sum() < mask.sum() and not (thin & ~mask).any()
        assert len(pieces(map(tuple, np.argwhere(thin)), True)) == len(pieces(map(tuple, np.argwhere(mask)), True))
        assert euler(thin) == euler(mask)
        outside = [len(pieces(map(tuple, np.argwhere(np.pad(~m, 1, constant_values=True))), False)) for m in (thin, mask)]
        assert outside[0] == outside[1]


@pytest.mark.parametrize(("shape", "sides"), [((50, 44), (9, 256)), ((20, 24, 22), (7, 48))])
def test_thinning_by_blocks_of_every_size(spark, shape, sides):
    labels, axes = volume(3, shape, 3), AXES[len(shape)]
    want = np.zeros(shape, bool)
    for name in np.unique(labels[labels > 0]):
        want |= geometry.skeletonize(labels == name)
    for side in sides:
        got = geometry.skeletons(frame(spark, labels, False), ["sample_id"], shape_of(labels), axes=axes, side=side)
        assert {tuple(r[a] for a in axes) for r in got.collect()} == set(map(tuple, np.argwhere(want)))


def dense_tensor(mask, sigma):
    s, inner = mask.ndim, max(1.0, sigma / 3)
    dt, m = dense_dt(mask), mask.astype(float)
    grads = [geometry.gaussian_filter(dt, inner, tuple(int(k == j) for k in range(s))) * m for j in reversed(range(s))]
    weight = np.maximum(geometry.gaussian_filter(m, sigma, (0,) * s), 1e-10)
    t = np.stack([geometry.gaussian_filter(grads[i] * grads[j], sigma, (0,) * s) / weight for i in range(s) for j in range(s)])
    w, diag = (dt / dt.max()) ** 2, [i * (s + 1) for i in range(s)]
    trace = t[diag].mean(0)
    t = t * (1 - w)
    t[diag] += w * trace
    return t


@pytest.mark.parametrize(("shape", "sigma", "side"), [((30, 41), 1.5, 8), ((12, 15, 13), 1.0, 6), ((30, 41), 5.0, 256)])
def test_tensors_equal_the_dense_filter(spark, shape, sigma, side):
    labels, axes = volume(5, shape, 2), AXES[len(shape)]
    got = geometry.structure_tensor(frame(spark, labels), ["sample_id"], shape_of(labels), sigma, axes=axes, side=side).collect()
    assert len(got) == (labels > 0).sum()
    for name in np.unique(labels[labels > 0]):
        want = dense_tensor(labels == name, sigma)
        for r in (r for r in got if r["label"] == name):
            assert r["tensor"] == pytest.approx(want[(slice(None), *(r[a] for a in axes))].tolist(), abs=1e-9)


@pytest.mark.parametrize("shape", [(33, 30), (10, 13, 12)])
def test_skeleton_targets_in_any_dimensions(spark, shape):
    labels, axes = volume(8, shape, 3), AXES[len(shape)]
    labels[tuple(n - 1 for n in shape)] = 9
    labels[tuple(n - 2 for n in shape)] = 0
    rows, size = frame(spark, labels), shape_of(labels)
    got = geometry.skeleton_targets(rows, ["sample_id"], size, axes=axes).collect()
    sites = {}
    for r in geometry.skeletons(rows, ["sample_id"], size, axes=axes).collect():
        sites.setdefault(r["label"], []).append(tuple(r[a] for a in axes))
    assert len(got) == (labels > 0).sum()
    for r in got:
        own = np.array([r[a] for a in axes])
        near = [r[f"n{a}"] for a in axes]
        if (labels == r["label"]).sum() == 1:
            assert near == [r[f"s{a}"] for a in axes] == [r[f"g{a}"] for a in axes] == [0] * len(axes) and r["dt_norm"] == 0
            continue
        want = min(sites[r["label"]], key=lambda p: (int(((np.array(p) - own) ** 2).sum()), p))
        gap = np.array(want) - own
        assert near == list(want) and [r[f"s{a}"] for a in axes] == pytest.approx(list(gap / max(np.linalg.norm(gap), 1e-12)))


def test_far_sites_are_found_in_wider_blocks(spark):
    labels = np.zeros((5, 120), int)
    labels[2] = 1
    voxels = geometry._foreground(frame(spark, labels), ["sample_id"], "label", "yx")
    got = geometry.nearest_sites(voxels, voxels.where("x = 3 or x = 4"), ["sample_id"], "label", "yx", reach=2, side=4).collect()
    assert len(got) == 120 and all(r["nx"] == (3 if r["x"] <= 3 else 4) and r["ny"] == 2 for r in got)
