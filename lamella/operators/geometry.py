"""Distance transforms, direction fields, structure tensors and skeletons of instances.

No instance has to fit a task: distances go line by line (`lines`), tensors, thinning and the search for the nearest
skeleton voxel block by block with halos (`blocks`).
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import lines
from lamella.operators.aggregates import spatial_centroids
from lamella.operators.blocks import SIDE, Dense, block_columns, block_sides, with_halos
from lamella.session import cut, settled


def _foreground(rows: DataFrame, by: list[str], label: str, axes: str, *more: str) -> DataFrame:
    return rows.where(F.col(label) > 0).select(*dict.fromkeys([*by, label, *axes, "lin", *more]))


def _line_keys(by: list[str], axes: str, axis: str) -> list[str]:
    return list(dict.fromkeys([*by, *(a for a in axes if a not in axis)]))


def _distances(rows: DataFrame, by: list[str], shape: dict[str, int], label: str, axes: str, gradient: bool) -> DataFrame:
    """Instance voxels with dt, dt_norm and, if wanted, g<axis>, in as few passes as planes allow."""
    groups = lines.planes(axes, shape)
    whole = len(groups) == 1  # then a group's instances are in a task, and so is their maximum

    def squares(group: str, last: bool):
        def fn(table: pa.Table, first: np.ndarray) -> dict[str, np.ndarray]:
            for axis in reversed(group):
                d2 = lines.turned(table, first, group, axis, lines.distance_pass(axis, shape[axis], label, "d2"), [label, "d2"])["d2"]
                table = table.set_column(table.schema.get_field_index("d2"), "d2", pa.array(d2))
            if not last:
                return {"d2": d2}
            near = d2 < lines.FAR / 2
            dt = np.where(near, np.sqrt(d2), 0.0)
            out = {"dt": np.where(near, dt, np.nan)}
            if gradient:
                out |= slopes(group)(table.append_column("_f", pa.array(dt)), first)
            if whole:
                new = np.zeros(len(dt), np.int64)
                new[first] = 1
                of = pd.DataFrame({"plane": np.cumsum(new), "label": table[label].to_numpy(), "dt": dt})
                top = of.groupby(["plane", "label"], sort=False)["dt"].transform("max").to_numpy()
                out["dt_norm"] = np.divide(dt, top, out=np.zeros(len(dt)), where=top > 0)
            return out

        return fn

    def slopes(group: str):
        def fn(table: pa.Table, first: np.ndarray) -> dict[str, np.ndarray]:
            out = {}
            for axis in group:
                out |= lines.turned(table, first, group, axis, lines.gradient_pass(axis, shape[axis], label, "_f", f"g{axis}"), [label, "_f"])
            return out

        return fn

    out = _foreground(rows, by, label, axes).withColumn("d2", F.lit(lines.FAR))
    for group in groups[:-1]:
        out = lines.along(out, _line_keys(by, axes, group), group, squares(group, False), "d2 double")
    names = ["dt", *(f"g{a}" for a in groups[-1] if gradient), *(["dt_norm"] if whole else [])]
    out = lines.along(out, _line_keys(by, axes, groups[-1]), groups[-1], squares(groups[-1], True), ", ".join(f"{n} double" for n in names)).drop("d2")
    if gradient and not whole:
        out = out.withColumn("_f", F.coalesce("dt", F.lit(0.0)))
        for group in groups[:-1]:
            out = lines.along(out, _line_keys(by, axes, group), group, slopes(group), ", ".join(f"g{a} double" for a in group))
        out = out.drop("_f")
    if whole:
        return out
    keys = list(dict.fromkeys([*by, label]))
    top = out.groupBy(*keys).agg(F.max("dt").alias("_top"))
    return out.join(top, keys).withColumn("dt_norm", F.when(F.col("_top") > 0, F.col("dt") / F.col("_top")).otherwise(F.lit(0.0))).drop("_top")


def distance_transform(rows: DataFrame, by: list[str], shape: dict[str, int], label: str = "label", axes: str = "yx") -> DataFrame:
    """dt: distance to the nearest voxel that isn't of the instance; dt_norm: by the instance's maximum.

    Separable: a lower envelope along each axis in turn. Voxels of a group (by) are distinct; what has no row is background.
    The volume's edge is no background. An instance that fills the volume has null dt and zero dt_norm.
    """
    return _distances(rows, by, shape, label, axes, False)


def distance_gradient(distances: DataFrame, by: list[str], shape: dict[str, int], label: str = "label", axes: str = "yx") -> DataFrame:
    """distances with g<axis>: central differences of dt, one-sided at the volume's edge; dt is zero outside the instance."""
    out = distances.withColumn("_f", F.coalesce("dt", F.lit(0.0)))
    for axis in axes:
        out = lines.along(out, _line_keys(by, axes, axis), axis, lines.gradient_pass(axis, shape[axis], label, "_f", f"g{axis}"), f"g{axis} double")
    return out.drop("_f")


def skeleton_depth_weight(rows: DataFrame, by: list[str], shape: dict[str, int], weight: float = 10.0, label: str = "label", axes: str = "yx") -> DataFrame:
    """1 + dt / max * (weight - 1) inside instances, 1 outside: (rows, weight)."""
    dt = distance_transform(rows, by, shape, label, axes).select("lin", "dt_norm")
    return rows.join(dt, "lin", "left").withColumn("weight", 1.0 + F.coalesce("dt_norm", F.lit(0.0)) * (weight - 1.0)).drop("dt_norm")


def centroid_direction(rows: DataFrame, by: list[str], label: str = "label", axes: str = "yx") -> DataFrame:
    """d<axis>: unit vector from the voxel to its instance's centroid; zero for background and at the centroid."""
    centres = spatial_centroids(rows, by, label)
    out = rows.join(centres, [*by, label], "left")
    gap = {a: F.col(f"c{a}") - F.col(a) for a in axes}
    size = F.sqrt(sum((g * g for g in gap.values()), F.lit(0.0)))
    return out.withColumns({f"d{a}": F.coalesce(F.when(size > 0, g / size), F.lit(0.0)) for a, g in gap.items()}).drop("cz", "cy", "cx")


def gaussian_kernel(sigma: float, order: int = 0) -> np.ndarray:
    """Sampled Gaussian (or its derivative) cut off at four sigma."""
    r = int(4.0 * sigma + 0.5)
    x = np.arange(-r, r + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    k /= k.sum()
    return k if order == 0 else -x / sigma**2 * k


def gaussian_filter(field: np.ndarray, sigma: float, orders: tuple[int | None, ...]) -> np.ndarray:
    """Separable filter with half-sample reflection at the edges; orders gives the derivative along each axis (None: no filter)."""
    for axis, order in enumerate(orders):
        if order is None:
            continue
        if field.shape[axis] == 1:
            field = field if order == 0 else np.zeros_like(field)
            continue
        k = gaussian_kernel(sigma, order)
        r = len(k) // 2
        lines = np.moveaxis(field, axis, -1)
        padded = np.pad(lines, [(0, 0)] * (lines.ndim - 1) + [(r, r)], mode="symmetric")
        # A derivative kernel is applied as a convolution: reversed.
        out = sum(w * padded[..., j : j + lines.shape[-1]] for j, w in enumerate(k[::-1]))
        field = np.moveaxis(out, -1, axis)
    return field


def structure_tensor(rows: DataFrame, by: list[str], shape: dict[str, int], sigma: float = 5.0, label: str = "label", axes: str = "yx", side: int | None = None) -> DataFrame:
    """tensor: S * S numbers, row by row in x, y(, z) order, of the smoothed gradient of each instance's distance transform.

    Gradients and products are smoothed inside the mask and divided by the smoothed mask; towards the medial axis
    the tensor turns isotropic with the squared normalised distance. A block has a halo of both filters' radii, so the
    result is that of filters over the whole volume; the volume's edge reflects.
    """
    s, inner = len(axes), max(1.0, sigma / 3.0)
    radius = len(gaussian_kernel(sigma)) // 2
    halo, side = radius + len(gaussian_kernel(inner)) // 2, side or SIDE[len(axes)]
    kept = list(dict.fromkeys([*by, label, *axes, "lin"]))
    fields = with_halos(distance_transform(rows, by, shape, label, axes).select(*kept, F.coalesce("dt", F.lit(0.0)).alias("_dt"), "dt_norm"), axes, side, halo)
    full = np.array([shape[a] for a in axes])

    def of_instance(places: np.ndarray, dt: np.ndarray, norm: np.ndarray, core: np.ndarray) -> np.ndarray:
        low = np.maximum(places.min(0) - radius, 0)
        high = np.minimum(places.max(0) + radius + 1, full)
        at = tuple((places - low).T)
        m, d = np.zeros(high - low), np.zeros(high - low)
        m[at], d[at] = 1.0, dt
        grads = [gaussian_filter(d, inner, tuple(int(k == j) for k in range(s))) * m for j in reversed(range(s))]
        weight = np.maximum(gaussian_filter(m, sigma, (0,) * s), 1e-10)
        at, w = tuple(a[core] for a in at), norm[core] ** 2
        t = np.zeros((int(core.sum()), s, s))
        for i, j in product(range(s), repeat=2):
            t[:, i, j] = (gaussian_filter(grads[i] * grads[j], sigma, (0,) * s) / weight)[at] if i <= j else t[:, j, i]
        trace = np.trace(t, axis1=1, axis2=2) / s
        t *= (1 - w)[:, None, None]
        t[:, range(s), range(s)] += (w * trace)[:, None]
        return t.reshape(len(t), s * s)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in pdf.groupby(label, sort=False):
            core = own["_core"].to_numpy()
            if core.any():
                got = of_instance(own[list(axes)].to_numpy(np.int64), own["_dt"].to_numpy(), own["dt_norm"].to_numpy(), core)
                out.append(own.loc[core, kept].assign(tensor=list(got)))
        return pd.concat(out) if out else pdf[kept].iloc[:0].assign(tensor=pd.Series([], dtype=object))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields.select(*kept).schema.fields)
    return fields.groupBy(*dict.fromkeys([*by, *block_columns(axes)])).applyInPandas(run, f"{kinds}, tensor array<double>")


def _neighbours(dims: int) -> tuple[list[tuple[int, ...]], list[int], list[int], int, int]:
    """Offsets of the neighbours (a bit each), which ones touch each of them fully and by faces, bits near enough to
    count as background, and bits of the faces."""
    around = [o for o in product((-1, 0, 1), repeat=dims) if any(o)]

    def touching(a, most):
        return sum(1 << k for k, b in enumerate(around) if a != b and max(abs(p - q) for p, q in zip(a, b, strict=True)) <= 1 and sum(abs(p - q) for p, q in zip(a, b, strict=True)) <= most)

    near = sum(1 << k for k, o in enumerate(around) if sum(map(abs, o)) <= 2)
    faces = sum(1 << k for k, o in enumerate(around) if sum(map(abs, o)) == 1)
    return around, [touching(a, dims) for a in around], [touching(a, 1) for a in around], near, faces


def _reached(seed: np.ndarray, allowed: np.ndarray, touching: list[int]) -> np.ndarray:
    """Bits of allowed that are connected with the seed's."""
    reach = seed & allowed
    while True:
        grown = reach.copy()
        for k, bits in enumerate(touching):
            grown |= np.where(reach >> k & 1, bits, 0)
        grown &= allowed
        if (grown == reach).all():
            return reach
        reach = grown


def simple(keys: np.ndarray, dims: int) -> np.ndarray:
    """Whether a voxel can go without changing the topology, by its neighbourhood (a bit for each instance voxel around).

    One foreground piece (full neighbourhood) and one background piece that touches it by a face; the background
    connects by faces within the neighbours at most two steps away.
    """
    _, full, by_face, near, faces = _neighbours(dims)
    empty = ~keys & near
    touch = empty & faces
    one = _reached(keys & -keys, keys, full) == keys
    return (keys != 0) & (touch != 0) & one & (touch & ~_reached(touch & -touch, empty, by_face) == 0)


def peel(label: np.ndarray, parity: np.ndarray, rounds: int) -> bool:
    """Thin the instances of a padded array in place: border voxels that are simple and no end points go, one subfield
    after another (2 ** dims of them a round; parity names a voxel's). Says whether the last round changed nothing.

    Voxels of a subfield are no neighbours of each other, so they go at the same time.
    """
    dims = label.ndim
    around, *_, faces = _neighbours(dims)
    strides = np.array([int(np.prod(label.shape[k + 1 :])) for k in range(dims)])
    steps = [int(np.dot(o, strides)) for o in around]
    flat, kind = label.ravel(), parity.ravel()
    alive = np.flatnonzero(flat)
    for _ in range(rounds):
        still = True
        for field in range(1 << dims):
            alive = alive[flat[alive] > 0]
            at = alive[kind[alive] == field]
            keys = np.zeros(len(at), np.int64)
            for k, step in enumerate(steps):
                keys |= (flat[at + step] == flat[at]).astype(np.int64) << k
            border = (~keys & faces != 0) & (keys & (keys - 1) != 0)  # two neighbours or more
            shapes, of = np.unique(keys[border], return_inverse=True)
            gone = at[border][simple(shapes, dims)[of.ravel()]] if len(shapes) else at[:0]
            flat[gone] = 0
            still &= not len(gone)
        if still:
            return True
    return False


def skeletonize(mask: np.ndarray, iterations: int = 50) -> np.ndarray:
    """Thinning of one array. Subfields count from the mask's own first voxels, so that a margin around it changes nothing."""
    if not mask.any():
        return mask.astype(bool)
    out = np.pad(mask.astype(np.int64), 1)
    low = np.argwhere(out).min(0) - 1
    peel(out, _parity(np.indices(out.shape).reshape(out.ndim, -1).T - low).reshape(out.shape), iterations)
    return out[(slice(1, -1),) * mask.ndim] > 0


def _parity(places: np.ndarray) -> np.ndarray:
    """The subfield of places counted from one before an instance's first."""
    return (places % 2) @ (1 << np.arange(places.shape[1])[::-1])


#: Subfields whose removals an exchange of halos allows for, by dimensions.
HALO = {2: 16, 3: 32}
#: Places of a block with its halo at most, by dimensions: for thinning, and for the search for sites within a reach of 8.
THINNED, SEARCHED = {2: 1 << 17, 3: 5 << 17}, {2: 1 << 16, 3: 3 << 16}


def skeletons(rows: DataFrame, by: list[str], shape: dict[str, int], iterations: int = 50, label: str = "label", axes: str = "yx", side: int | None = None) -> DataFrame:
    """Voxels of each instance's skeleton, by thinning to a fixed point (`iterations` rounds at most).

    A round has 2 ** dimensions subfields and each one looks one voxel further, so blocks with a halo of HALO voxels thin
    for HALO subfields on their own; then the voxels that are left are dealt anew, until a round takes no voxel of any block
    (_gone: those that the last round took). A volume that is one block is thinned at once. The result is that of the whole volume.
    """
    dims, halo = len(axes), HALO[len(axes)]
    sides = block_sides(axes, shape, halo, THINNED[dims]) if side is None else dict.fromkeys(axes, side)
    keys = list(dict.fromkeys([*by, label]))
    fg = _foreground(rows, by, label, axes)
    first = fg.groupBy(*keys).agg(*[(F.min(a) - 1).alias(f"_low{a}") for a in axes])
    now = fg.join(first, keys)
    parity = sum(((F.pmod(F.col(a) - F.col(f"_low{a}"), F.lit(2)) * (1 << (dims - 1 - k))) for k, a in enumerate(axes)), F.lit(0))
    now = now.withColumn("_p", parity.cast("int")).drop(*[f"_low{a}" for a in axes]).withColumn("_gone", F.lit(False))
    schema, columns, blocks = now.schema, now.columns, block_columns(axes)

    def thinning(rounds: int):
        def thin(pdf: pd.DataFrame) -> pd.DataFrame:
            core = pdf["_core"].to_numpy()
            if not core.any():
                return pdf[columns].iloc[:0]
            box = Dense(pdf[list(axes)].to_numpy(np.int64))
            _, names = np.unique(pdf[label].to_numpy(), return_inverse=True)
            labels = np.pad(box.array(names.ravel().astype(np.int32) + 1), 1)
            parity, at = np.pad(box.array(pdf["_p"].to_numpy(np.int8)), 1), tuple(a + 1 for a in box.at)
            still = peel(labels, parity, rounds - 1)
            before = core & (labels[at] > 0)
            if not still:
                peel(labels, parity, 1)
            return pdf.loc[before, columns].assign(_gone=labels[at][before] == 0)

        return thin

    left = iterations
    while left > 0:
        n = min(max(1, halo >> dims), left) if sides else left
        now = settled(with_halos(now, axes, sides, halo).groupBy(*dict.fromkeys([*by, *blocks])).applyInPandas(thinning(n), schema))
        left -= n
        changed = left > 0 and now.where("_gone").limit(1).count()
        now = now.where("not _gone")
        if not changed:
            break
    return now.where("not _gone").drop("_p", "_gone")


def nearest_sites(voxels: DataFrame, sites: DataFrame, by: list[str], label: str, axes: str, reach: int = 8, side: int | None = None, shape: dict[str, int] | None = None) -> DataFrame:
    """voxels with n<axis>, the nearest site of the same instance, the first in raster order on ties. Every instance has one.

    A voxel looks at the sites of its block and a halo of `reach` around it; a site nearer than the reach is the nearest.
    Voxels that have none look again with a reach four times as large, in blocks that grow with it. In a block, voxels
    look cell by cell at the sites within the reach of their cell. With the volume's shape, short axes are not cut.
    """
    kept = voxels.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in voxels.schema.fields)
    schema = ", ".join([kinds, *(f"n{a} double" for a in axes), "_known boolean"])
    keys = list(dict.fromkeys([*by, label]))
    dims, done, todo = len(axes), None, voxels

    def within(reach: int):
        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            near, known = np.full((len(left), len(axes)), np.nan), np.zeros(len(left), bool)
            spots, all_targets = left[list(axes)].to_numpy(np.int64), right[list(axes)].to_numpy(np.int64)
            own = right.groupby(label).indices
            for name, at in left.groupby(label).indices.items():
                if name not in own:
                    continue
                targets = all_targets[own[name]]
                targets = targets[np.lexsort(targets.T[::-1])]
                cell = spots[at] // (4 * reach)
                order = np.lexsort(cell.T)
                ends = np.append(np.flatnonzero((cell[order][1:] != cell[order][:-1]).any(1)) + 1, len(at))
                for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                    some = at[order[start:end]]
                    places = spots[some]
                    around = targets[((targets >= places.min(0) - reach) & (targets <= places.max(0) + reach)).all(1)]
                    if not len(around):
                        continue
                    step = max(1, (1 << 20) // len(around))
                    for a in range(0, len(some), step):
                        d = sum((places[a : a + step, k, None] - around[None, :, k]) ** 2 for k in range(dims))
                        best = d.argmin(1)
                        ok = d[np.arange(len(best)), best] <= reach * reach
                        near[some[a : a + step][ok]], known[some[a : a + step][ok]] = around[best[ok]], True
            return left[kept].assign(**{f"n{a}": near[:, k] for k, a in enumerate(axes)}, _known=known)

        return meet

    on = list(dict.fromkeys([*by, *block_columns(axes)]))
    sites = sites.select(*[F.col(c).alias(c) for c in dict.fromkeys([*keys, *axes])])  # columns of its own, if both come from the same rows
    while True:
        if shape is not None and side is None:
            block = block_sides(axes, shape, reach, SEARCHED[dims] * max(1, reach // 8) ** dims)
        else:
            block = max(side or SIDE[dims] // 4, reach)
        cells = with_halos(todo, axes, block, 0).groupBy(*on)
        around = with_halos(sites, axes, block, reach).groupBy(*on)
        got = cut(cells.cogroup(around).applyInPandas(within(reach), schema))
        found = got.where("_known").drop("_known")
        done = found if done is None else done.unionByName(found)
        todo = got.where("not _known").select(*kept)
        if not todo.limit(1).count():
            return done
        reach *= 4


def skeleton_targets(rows: DataFrame, by: list[str], shape: dict[str, int], iterations: int = 50, label: str = "label", axes: str = "yx") -> DataFrame:
    """For each instance voxel: the nearest skeleton voxel n<axis>, the unit direction to it s<axis>, dt_norm and the
    gradient g<axis> of the distance. First skeleton voxel in raster order on ties; instances of one voxel have zeros."""
    keys = list(dict.fromkeys([*by, label]))
    fields = cut(_distances(rows, by, shape, label, axes, True))
    out = nearest_sites(fields, skeletons(rows, by, shape, iterations, label, axes), by, label, axes, shape=shape)
    single = fields.groupBy(*keys).count().where("count = 1").select(*keys, F.lit(True).alias("_one"))
    out = out.join(single, keys, "left")
    gap = {a: F.col(f"n{a}") - F.col(a) for a in axes}
    size = F.sqrt(sum((g * g for g in gap.values()), F.lit(0.0)))
    out = out.withColumns({f"s{a}": F.when(size > 0, g / size).otherwise(F.lit(0.0)) for a, g in gap.items()})
    names = [*(f"n{a}" for a in axes), *(f"s{a}" for a in axes), "dt_norm", *(f"g{a}" for a in axes)]
    return out.select(*dict.fromkeys([*keys, *axes, "lin"]), *[F.when(F.col("_one"), F.lit(0.0)).otherwise(F.col(n)).alias(n) for n in names])


def pca_rgb(rows: DataFrame, embedding: str = "embedding", key: str = "lin") -> DataFrame:
    """(key, r, g, b): the three main components of the centred vectors, each scaled to [0, 1] over all rows.

    The covariance is a sum over rows of fixed size; signs are set so that the largest loading is positive. No rows
    give no rows; null vectors are left out.
    """
    vectors = rows.select(key, F.col(embedding).cast("array<double>").alias("e")).where("e is not null")

    def moments(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["e"].to_numpy())
                yield pd.DataFrame({"v": [np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))]})

    parts = vectors.mapInPandas(moments, "v array<double>")
    folded = parts.select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
    if not folded:
        return vectors.select(key, *[F.lit(None).cast("double").alias(c) for c in "rgb"])
    sums = np.array([r["v"] for r in folded])
    d = int(round((np.sqrt(4 * len(sums) - 3) - 1) / 2))  # 1 + d + d * d sums
    n, s, q = sums[0], sums[1 : d + 1], sums[d + 1 :]
    mean = s / n
    cov = q.reshape(len(s), -1) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    main = axes[:, ::-1][:, :3].T
    main = main * np.sign(main[np.arange(len(main)), np.abs(main).argmax(1)])[:, None]
    weights = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in main])
    centre = F.array(*[F.lit(float(v)) for v in mean])
    p = vectors.select(key, F.transform(weights, lambda w: F.aggregate(F.zip_with(F.zip_with("e", centre, lambda a, b: a - b), w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)).alias("p"))
    ends = p.agg(*[f(F.col("p")[k]).alias(f"{n_}{k}") for k in range(3) for f, n_ in ((F.min, "lo"), (F.max, "hi"))])
    scaled = p.join(F.broadcast(ends), how="cross")  # one row
    return scaled.select(key, *[((F.col("p")[k] - F.col(f"lo{k}")) / F.greatest(F.col(f"hi{k}") - F.col(f"lo{k}"), F.lit(1e-12))).alias(c) for k, c in enumerate("rgb")])
