"""Mean shift over groups (classes) in one job: modes and vectors of a group meet, wherever they are.

Few modes (HELD numbers at most, checked) are held by the driver and sent along with each pass over the vectors. More
stay a table: vectors lie in cells of the kernel's reach along the PLANES widest axes (a difference along an axis is no
longer than the distance), each mode visits the cells around it, and cells are dealt in chunks of vectors and blocks of
modes. Either way a pass gives one weighted sum a mode; nothing is emitted for a pair. Both give the same results.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.plans.rank import numbered_within
from lamella.session import cut, settled

#: Numbers (modes times dimensions) that the driver holds; beyond that modes are a table.
HELD = 1 << 20
#: Axes of the cells, vectors of a chunk, modes of a block.
PLANES, CHUNK, BLOCK = 3, 8192, 2048
#: A mode is at rest when it moves by no more than this share of the bandwidth.
REST = 1e-3


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def _squared(x: np.ndarray, modes: np.ndarray) -> np.ndarray:
    """Squared distances, computed from differences so that equal vectors are at zero."""
    return ((x[:, None, :] - modes[None]) ** 2).sum(-1)


def _steps(n: int, size: int) -> range:
    """Starts of steps through n rows so that rows times size numbers are a few tens of megabytes."""
    return range(0, n, _step(size))


def _step(size: int) -> int:
    return max(1, (1 << 22) // max(size, 1))


class Vectors:
    """Foreground vectors (by, x) and, once asked for, the cells they lie in."""

    def __init__(self, rows: DataFrame, by: list[str], embedding: str):
        self.rows = rows.select(*by, F.col(embedding).cast("array<double>").alias("x")).where("x is not null")
        for b in by:
            self.rows = self.rows.where(F.col(b).isNotNull())
        self.by = by
        self.of_by = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in self.rows.select(*by).schema.fields)
        self._axes: list[int] | None = None
        self._cells: dict[float, tuple[DataFrame, DataFrame]] = {}

    def axes(self) -> list[int]:
        """The axes along which the vectors spread most."""
        if self._axes is None:
            spread = self.rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.var_pop("v").alias("s")).orderBy(F.desc("s"), "k").limit(PLANES)
            self._axes = [r["k"] for r in spread.collect()]
        return self._axes

    def cell(self, side: float) -> list[Column]:
        return [F.floor(F.element_at("x", k + 1) / side).cast("long").alias(f"c{n}") for n, k in enumerate(self.axes())]

    def in_cells(self, side: float) -> tuple[DataFrame, DataFrame]:
        """(by, c<n>, chunk, x), and the chunks that there are: (by, c<n>, chunk)."""
        if side not in self._cells:
            on = [*self.by, *(f"c{n}" for n in range(len(self.axes())))]
            placed = self.rows.select(*self.by, "x", *self.cell(side), F.monotonically_increasing_id().alias("_row"))
            chunks = placed.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_n"))
            placed = cut(placed.join(chunks, on).withColumn("chunk", F.pmod(F.xxhash64("_row"), F.col("_n")).cast("int")).select(*on, "chunk", "x"))
            self._cells[side] = placed, chunks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        return self._cells[side]

    def around(self, modes: DataFrame, side: float) -> DataFrame:
        """modes (by, mode, x, ...) once for each cell that their reach of `side` touches."""
        shifts = F.array(*[F.array(*[F.lit(v) for v in s]) for s in product((-1, 0, 1), repeat=len(self.axes()))])
        out = modes.withColumns({f"_c{n}": c for n, c in enumerate(self.cell(side))}).withColumn("_s", F.explode(shifts))
        return out.withColumns({f"c{n}": F.col(f"_c{n}") + F.col("_s")[n] for n in range(len(self.axes()))}).drop("_s", *[f"_c{n}" for n in range(len(self.axes()))])


def _summed(parts: DataFrame, by: list[str], of_by: str) -> DataFrame:
    """Partial sums (by, mode, w, s) of tasks added up."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(w=pdf["w"].sum(), s=[_matrix(pdf["s"]).sum(0)])

    return parts.groupBy(*by, "mode").applyInPandas(add, f"{of_by}mode long, w double, s array<double>")


def held_means(vectors: Vectors, groups: list[tuple], modes: np.ndarray, kernel: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Weights and weighted sums for modes that the driver holds; groups: the values of by of each mode."""
    by = vectors.by
    places: dict[tuple, np.ndarray] = {}
    for k, g in enumerate(groups):
        places.setdefault(g, []).append(k)
    places = {g: np.array(v) for g, v in places.items()}

    def run(batches):
        total, weight = np.zeros_like(modes), np.zeros(len(modes))
        for pdf in batches:
            for g, own in pdf.groupby(by, sort=False) if by else [((), pdf)]:
                at = places.get(g if isinstance(g, tuple) else (g,))
                if at is None or not len(own):
                    continue
                x = _matrix(own["x"])
                own_modes = modes[at]
                for a in _steps(len(x), own_modes.size):
                    some = x[a : a + _step(own_modes.size)]
                    w = kernel(_squared(some, own_modes))
                    total[at] += w.T @ some
                    weight[at] += w.sum(0)
        some = np.flatnonzero(weight > 0)
        yield pd.DataFrame({"mode": some, "w": weight[some], "s": pd.Series(list(total[some]), dtype=object)})

    got = _summed(vectors.rows.mapInPandas(run, "mode long, w double, s array<double>"), [], "").toPandas()
    weights, sums = np.zeros(len(modes)), np.zeros_like(modes)
    if len(got):
        weights[got["mode"]], sums[got["mode"]] = got["w"], _matrix(got["s"])
    return weights, sums


def met(vectors: Vectors, modes: DataFrame, count: int, side: float, fn: Callable[[np.ndarray, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn(vectors of a chunk, modes within reach of it), for every chunk and block of modes."""
    members, chunks = vectors.in_cells(side)
    cells = [*vectors.by, *(f"c{n}" for n in range(len(vectors.axes())))]
    blocks = -(-count // BLOCK)
    asked = vectors.around(modes, side).withColumn("block", F.pmod(F.xxhash64("mode"), F.lit(blocks)).cast("int")).join(chunks, cells)
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of its own: modes come from the same rows
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = [*cells, "chunk", "block"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return fn(_matrix(left["x"]), right) if len(left) and len(right) else empty

    empty = pd.DataFrame({part.split()[0]: [] for part in schema.split(", ")}, dtype=object)
    return members.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, schema)


def table_means(vectors: Vectors, modes: DataFrame, count: int, reach: float) -> DataFrame:
    """(by, mode, w, s) of a flat kernel for a table of modes."""
    by = vectors.by

    def sums(x: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        m, weight, total = _matrix(own["x"]), np.zeros(len(own)), np.zeros((len(own), x.shape[1]))
        n = _step(x.size)
        for a in range(0, len(m), n):
            w = (_squared(x, m[a : a + n]) <= reach * reach).astype(float)
            weight[a : a + n], total[a : a + n] = w.sum(0), w.T @ x
        return own[[*by, "mode"]].assign(w=weight, s=list(total))[weight > 0]

    return _summed(met(vectors, modes, count, reach, sums, f"{vectors.of_by}mode long, w double, s array<double>"), by, vectors.of_by)


def seeds(vectors: Vectors, bandwidth: float) -> DataFrame:
    """(by, mode, x): the occupied bins of width `bandwidth`; the vectors themselves in a group where each has its own bin."""
    by = vectors.by
    bins = vectors.rows.withColumn("b", F.transform("x", lambda v: F.rint(v / bandwidth) + 0.0)).groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))
    single = bins.groupBy(*by).agg((F.max("n") == 1).alias("single"))
    bins = bins.join(single, by) if by else bins.crossJoin(F.broadcast(single))  # one row
    return cut(bins.select(*by, F.monotonically_increasing_id().alias("mode"), F.when(F.col("single"), F.col("x")).otherwise(F.transform("b", lambda v: v * bandwidth)).alias("x")))


def _groups(modes: pd.DataFrame, by: list[str]) -> list[tuple]:
    return list(modes[by].itertuples(index=False, name=None)) if by else [()] * len(modes)


def _by_priority(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Order of modes: most vectors first, then the greater vector component by component."""
    return np.lexsort((*[-x[:, k] for k in reversed(range(x.shape[1]))], -n))


def _held_flat(vectors: Vectors, start: pd.DataFrame, bandwidth: float, iterations: int) -> pd.DataFrame:
    """Modes (by, x) at rest, merged, in their order; all held by the driver."""
    groups = _groups(start, vectors.by)
    x, n, active = _matrix(start["x"]), np.zeros(len(start)), np.arange(len(start))
    for step in range(iterations + 1):
        weights, sums = held_means(vectors, [groups[k] for k in active], x[active], lambda d: (d <= bandwidth**2).astype(float))
        some = weights > 0
        mean = sums[some] / weights[some, None]
        moved = np.linalg.norm(mean - x[active[some]], axis=1) > REST * bandwidth
        n[active], x[active[some]] = weights, mean
        active = active[some][moved]
        if not len(active) or step == iterations:
            break
    out, where = [], {}
    for k, g in enumerate(groups):
        where.setdefault(g, []).append(k)
    for g, at in where.items():
        at = np.array(at)[n[at] > 0]
        kept: list[int] = []
        for k in at[_by_priority(n[at], x[at])]:
            if not kept or (((x[kept] - x[k]) ** 2).sum(1) > bandwidth**2).all():
                kept.append(k)
        out += [(*g, place, n[k], x[k].tolist()) for place, k in enumerate(kept, 1)]
    return pd.DataFrame(out, columns=[*vectors.by, "cluster", "n", "x"])


def _table_flat(vectors: Vectors, modes: DataFrame, bandwidth: float, iterations: int) -> DataFrame:
    """The same for a table of modes: (by, cluster, n, x)."""
    by, done = vectors.by, None
    active = modes
    for step in range(iterations + 1):
        count = active.count()
        if not count:
            break
        means = table_means(vectors, active, count, bandwidth).select("mode", "w", F.transform("s", lambda v: v / F.col("w")).alias("mean"))
        after = active.join(means, "mode").withColumn("_d", F.sqrt(F.aggregate(F.zip_with("x", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
        after = cut(after.select(*by, "mode", "w", F.col("mean").alias("x"), (F.col("_d") > REST * bandwidth).alias("moved")))
        rest = after.where("not moved" if step < iterations else "true").select(*by, "mode", F.col("w").alias("n"), "x")
        done = rest if done is None else done.unionByName(rest)
        active = after.where("moved").select(*by, "mode", "x")
    # modes that came to the same place are one
    same = F.transform("x", lambda v: F.rint(v / (1e-9 * bandwidth)) + 0.0)
    left = cut(done.groupBy(*by, same.alias("_k")).agg(F.max(F.struct("n", "x")).alias("m"), F.min("mode").alias("mode")).select(*by, "mode", "m.n", "m.x"))
    kept = None
    while (count := left.count()):
        # a mode that no better one is near stays; what is near one that stays goes
        leaders = cut(left.join(_outranked(vectors, left, left, count, bandwidth), "mode", "left_anti"))
        kept = leaders if kept is None else kept.unionByName(leaders)
        rest = left.join(leaders.select("mode"), "mode", "left_anti")
        left = settled(rest.join(_outranked(vectors, rest, leaders, count, bandwidth), "mode", "left_anti"))
    if kept is None:
        return modes.sparkSession.createDataFrame([], f"{vectors.of_by}cluster long, n double, x array<double>")
    return _ranked(kept, by)


def _outranked(vectors: Vectors, modes: DataFrame, others: DataFrame, count: int, bandwidth: float) -> DataFrame:
    """(mode) of the modes that have one of the others of higher order within the bandwidth."""
    by = vectors.by
    cells = Vectors.__new__(Vectors)
    cells.by, cells.of_by, cells._axes, cells._cells = by, vectors.of_by, vectors.axes(), {}
    cells.rows = others.select(*by, F.concat("x", F.array("n")).alias("x"))

    def better(x: np.ndarray, own: pd.DataFrame) -> pd.DataFrame:
        m, n = _matrix(own["x"]), own["n"].to_numpy()
        hit = np.zeros(len(own), bool)
        for k in range(len(own)):
            near = x[((x[:, :-1] - m[k]) ** 2).sum(1) <= bandwidth**2]
            near = near[near[:, -1] >= n[k]]
            for row in near:
                if row[-1] > n[k] or tuple(row[:-1]) > tuple(m[k]):
                    hit[k] = True
                    break
        return own.loc[hit, ["mode"]]

    return met(cells, modes.select(*by, "mode", "n", "x"), count, bandwidth, better, "mode long").distinct()


def _ranked(kept: DataFrame, by: list[str]) -> DataFrame:
    """kept with cluster: its place in the order within its group, from 1."""
    rows = kept.select(*by, "n", "x", (-F.col("n")).alias("_n"), F.transform("x", lambda v: -v).alias("_x"))
    return numbered_within(rows, by, ["_n", "_x"], "_place").select(*by, (F.col("_place") + 1).alias("cluster"), "n", "x")


def nearest_modes(rows: DataFrame, modes, by: list[str], reach: float, embedding: str = "embedding", none: int | None = 0) -> DataFrame:
    """rows with the nearest mode's number (`cluster`, the first of equals, which is the smaller one where modes are in order;
    `none` in a group without modes or for a null vector).

    Held modes (a pandas table) go along with one pass. A table of modes is met in cells; vectors that none of the modes
    is within the reach of look again with a reach four times as large.
    """
    names = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    if isinstance(modes, pd.DataFrame):
        held = {(): (modes["cluster"].to_numpy(), _matrix(modes["x"]))} if not by else {g if isinstance(g, tuple) else (g,): (own["cluster"].to_numpy(), _matrix(own["x"])) for g, own in modes.groupby(by)}

        def run(batches):
            for pdf in batches:
                out, hit = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
                known = pdf[embedding].notna().to_numpy()
                for g, at in pdf.groupby(by).indices.items() if by else [((), np.arange(len(pdf)))]:
                    own = held.get(g if isinstance(g, tuple) else (g,))
                    at = at[known[at]]
                    hit[at] = own is not None and len(own[0]) > 0
                    for a in _steps(len(at), own[1].size) if own is not None and len(own[0]) else ():
                        spot = at[a : a + _step(own[1].size)]
                        out[spot] = own[0][_squared(_matrix(pdf[embedding].iloc[spot]), own[1]).argmin(1)]
                yield pdf.assign(cluster=pd.Series(out, index=pdf.index, dtype="Int64").where(hit, pd.NA if none is None else none))

        return rows.mapInPandas(run, f"{kinds}, cluster long")
    # modes stand for the vectors, and the rows visit them
    vectors = Vectors(modes.withColumn("_e", F.concat("x", F.array(F.col("cluster").cast("double")))), by, "_e")
    vectors._axes = Vectors(modes, by, "x").axes()
    marked = cut(rows.withColumn("mode", F.monotonically_increasing_id()))
    todo, found = marked.select(*by, "mode", F.col(embedding).cast("array<double>").alias("x")).where("x is not null"), None
    present = modes.select(*by).distinct() if by else None
    todo = cut(todo.join(present, by, "left_semi") if by else todo)
    while (count := todo.count()):

        def near(x: np.ndarray, own: pd.DataFrame, reach: float = reach) -> pd.DataFrame:
            m, out = _matrix(own["x"]), []
            n = _step(x.size)
            for a in range(0, len(m), n):
                d = _squared(x[:, :-1], m[a : a + n])
                best = d.min(0)
                out += [(b, int(x[d[:, k] == b, -1].min())) for k, b in enumerate(best)]
            return own[["mode"]].assign(d=[o[0] for o in out], cluster=[o[1] for o in out])[[o[0] <= reach * reach for o in out]]

        got = met(vectors, todo, count, reach, near, "mode long, d double, cluster long")
        got = cut(got.groupBy("mode").agg(F.min(F.struct("d", "cluster")).alias("m")).select("mode", F.col("m.cluster").alias("cluster")))
        found = got if found is None else found.unionByName(got)
        todo, reach = cut(todo.join(got, "mode", "left_anti")), reach * 4
    if found is None:
        return rows.withColumn("cluster", F.lit(none).cast("long"))
    return marked.join(found, "mode", "left").withColumn("cluster", F.coalesce("cluster", F.lit(none).cast("long"))).select(*names, "cluster")


def flat_clusters(rows: DataFrame, bandwidth: float, by: list[str] | None = None, iterations: int = 300, embedding: str = "embedding", held: int | None = None) -> DataFrame:
    """rows with cluster: flat-kernel mean shift from binned seeds, each group (by) for itself.

    A seed moves to the mean of the vectors within the bandwidth until it moves by no more than REST of it. Modes are
    numbered from 1 by the vectors around them, most first, then by the greater vector; one within the bandwidth of an
    earlier one goes. Every vector takes the nearest mode. Where no seed of a group has a vector within reach, the
    group is one cluster. Rows whose vector or group is null get 0.
    """
    by = by or []
    vectors = Vectors(rows, by, embedding)
    start = seeds(vectors, bandwidth)
    size = start.agg(F.sum(F.size("x")).alias("n")).first()["n"] or 0
    if size <= (HELD if held is None else held):
        modes = _held_flat(vectors, start.toPandas(), bandwidth, iterations) if size else pd.DataFrame(columns=[*by, "cluster", "n", "x"])
    else:
        modes = cut(_table_flat(vectors, start, bandwidth, iterations))
    out = nearest_modes(rows, modes, by, bandwidth, embedding)
    known = F.col(embedding).isNotNull()
    for b in by:
        known = known & F.col(b).isNotNull()
    return out.withColumn("cluster", F.when((F.col("cluster") == 0) & known, F.lit(1)).otherwise(F.col("cluster")).cast("long"))


def merge_modes(modes: np.ndarray, distance: float) -> np.ndarray:
    """Keep a mode if no kept one of lower index is closer than the distance."""
    kept: list[np.ndarray] = []
    for m in modes:
        if all(np.linalg.norm(m - k) >= distance for k in kept):
            kept.append(m)
    return np.array(kept).reshape(-1, modes.shape[1])


def soft_modes(vectors: DataFrame, by: list[str], bandwidth: float, iterations: int, max_seeds: int, seed: int, key: str, embedding: str, held: int) -> pd.DataFrame:
    """(by, cluster, x): modes of a Gaussian kernel from at most max_seeds seeds a group, the first by a hash of the key.

    All groups shift in the same passes; as many groups at a time as the driver can hold the modes of.
    """
    from pyspark.sql import Window

    order = [F.xxhash64(F.lit(seed), key), F.col(key)]
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) if by else None
    known = vectors.where(F.col(embedding).isNotNull())
    for b in by:
        known = known.where(F.col(b).isNotNull())
    rows = known.select(*by, F.col(embedding).cast("array<double>").alias("x"), key)
    picked = rows.withColumn("_n", first).where(F.col("_n") <= max_seeds).orderBy(*by, "_n") if by else rows.orderBy(*order).limit(max_seeds)
    if not by:
        return _soft(Vectors(vectors, by, embedding), picked.select("x").toPandas(), bandwidth, iterations)
    size = picked.groupBy(*by).agg(F.sum(F.size("x")).alias("n")).orderBy(*by).collect()  # a row a group
    out, batch, total = [], [], 0
    for k, r in enumerate(size):
        batch.append(tuple(r[b] for b in by))
        total += r["n"]
        if k + 1 == len(size) or total + size[k + 1]["n"] > held:
            chosen = vectors.sparkSession.createDataFrame(batch, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*by).schema.fields))
            of_batch = vectors.join(F.broadcast(chosen), by, "left_semi")  # groups whose modes the driver holds
            start = picked.join(F.broadcast(chosen), by, "left_semi").select(*by, "x", "_n").toPandas().sort_values([*by, "_n"], ignore_index=True)
            out.append(_soft(Vectors(of_batch, by, embedding), start, bandwidth, iterations))
            batch, total = [], 0
    return pd.concat(out) if out else pd.DataFrame(columns=[*by, "cluster", "x"])


def _soft(vectors: Vectors, start: pd.DataFrame, bandwidth: float, iterations: int) -> pd.DataFrame:
    groups, x = _groups(start, vectors.by), _matrix(start["x"])
    for _ in range(iterations if len(groups) else 0):
        weights, sums = held_means(vectors, groups, x, lambda d: np.exp(-d / (2 * bandwidth**2)))
        x = np.where(weights[:, None] > 1e-12, sums / np.maximum(weights, 1e-12)[:, None], x)
        where: dict[tuple, list[int]] = {}
        for k, g in enumerate(groups):
            where.setdefault(g, []).append(k)
        merged = {g: merge_modes(x[at], 0.5 * bandwidth) for g, at in where.items()}
        groups, x = [g for g, m in merged.items() for _ in m], np.concatenate(list(merged.values()))
    count: dict[tuple, int] = {}
    out = []
    for g, m in zip(groups, x, strict=True) if groups else ():
        count[g] = count.get(g, 0) + 1
        out.append((*g, count[g], m.tolist()))
    return pd.DataFrame(out, columns=[*vectors.by, "cluster", "x"])


def soft_assigned(rows: DataFrame, modes: pd.DataFrame, by: list[str], bandwidth: float, temperature: float, embedding: str = "embedding") -> DataFrame:
    """rows with cluster (the mode of the largest share, the first of equals; 0 without modes) and share, its part of a
    softmax over the group's modes."""
    held = {(): _matrix(modes["x"])} if not by else {g if isinstance(g, tuple) else (g,): _matrix(own["x"]) for g, own in modes.groupby(by)}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for pdf in batches:
            cluster, share = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            known = pdf[embedding].notna().to_numpy()
            for g, at in pdf.groupby(by).indices.items() if by else [((), np.arange(len(pdf)))]:
                own = held.get(g if isinstance(g, tuple) else (g,))
                at = at[known[at]]
                for a in _steps(len(at), own.size) if own is not None and len(own) else ():
                    spot = at[a : a + _step(own.size)]
                    logits = -_squared(_matrix(pdf[embedding].iloc[spot]), own) / (2 * bandwidth**2 * temperature)
                    top = logits.max(1, keepdims=True)
                    cluster[spot], share[spot] = logits.argmax(1) + 1, 1 / np.exp(logits - top).sum(1)
            yield pdf.assign(cluster=cluster, share=share)

    return rows.mapInPandas(run, f"{kinds}, cluster long, share double")
