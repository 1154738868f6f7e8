"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced partitions by recursive bisection (the cut follows the
graph's slow eigenvector, each half gets half of the nodes, swaps then lower the edges cut). A small classifier
learns a vector's partition. It gives every vector its place in the index and every query its most probable
partitions; their members are ranked by exact distance. How many partitions a query visits is set on vectors that
the classifier was not fitted on, which have to find their neighbours in the sample at RECALL (over all levels).

Partitions grow in number with the vectors: there is one for PER_PARTITION of them. Where that is more than MOST, the
partitions of a level are cut again in the same way, each with a graph and classifier of its own that a task fits on a
sample of the partition, level by level. The fit takes SAMPLE vectors of a partition at most, chosen by hash; all
vectors are indexed. A partition is dealt in chunks of CHUNK rows, so a partition that holds a third of all vectors is
many tasks, and equal distances are ordered by vec_id over all chunks.

Vectors that are null or zero, that hold null or non-finite components, that have a null vec_id, or whose length
is not the commonest one take no part. Rows with the query's vec_id are its own; of different query vectors under one
vec_id the least (component by component) asks. Distances are taken on vectors scaled by a power of two where their
squares would leave the range of doubles. Extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.session import cut

SAMPLE = 6000
#: Vectors that a partition holds on average, most partitions that one is cut into, and rows of a chunk.
PER_PARTITION, MOST, CHUNK = 250, 256, 20_000
NEIGHBOURS = 10
RECALL = 0.95

RESULT = "query_id long, rank int, vec_id long, score double"


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest others of each row."""
    out = np.empty((len(x), k), np.int64)
    norm = (x * x).sum(1)
    for a in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[a : a + 1024] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1024] = np.argpartition(d, k, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, edges: np.ndarray, share: float, seed: int) -> np.ndarray:
    """Which of the nodes go left: the given share of them, with few edges cut. edges: places in nodes."""
    n = len(nodes)
    u, v = edges
    degree = np.bincount(u, minlength=n) + 1.0
    f = np.random.default_rng(seed).standard_normal(n)
    for _ in range(60):  # lazy random walk, without its constant part
        f -= (f * degree).sum() / degree.sum()
        f = 0.5 * (f + (np.bincount(u, f[v], n) + f) / degree)
        f /= np.abs(f).max() + 1e-30
    count = min(max(1, round(n * share)), n - 1)
    left = np.zeros(n, bool)
    left[np.argsort(f, kind="stable")[:count]] = True
    for _ in range(12):  # swap the pairs that gain most
        gain = np.bincount(u, np.where(left[u] != left[v], 1.0, -1.0), n)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = max(1, min(len(a), len(b)) // 20)
        good = gain[a[:m]] + gain[b[:m]] > 2
        if not good.any():
            break
        left[a[:m][good]], left[b[:m][good]] = False, True
    return left


def partition(neighbours: np.ndarray, parts: int) -> np.ndarray:
    """Balanced partition of the symmetric neighbour graph: a part for each node."""
    n, k = neighbours.shape
    u, v = np.repeat(np.arange(n), k), neighbours.ravel()
    u, v = np.concatenate((u, v)), np.concatenate((v, u))
    part = np.zeros(n, np.int64)
    todo = [(np.arange(n), 0, parts)]
    while todo:
        nodes, first, count = todo.pop()
        if count == 1 or len(nodes) < 2:
            part[nodes] = first
            continue
        place = np.full(n, -1)
        place[nodes] = np.arange(len(nodes))
        inside = (place[u] >= 0) & (place[v] >= 0)
        half = count // 2
        left = _bisect(nodes, (place[u[inside]], place[v[inside]]), half / count, first)
        todo += [(nodes[left], first, half), (nodes[~left], first + half, count - half)]
    return part


class Router:
    """A network with one hidden layer from a vector to the logarithms of its partitions' probabilities."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 96, rounds: int = 20):
        rng = np.random.default_rng(7)
        self.unit = unit(x)
        x = x * self.unit
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        x = (x - self.mean) / self.scale
        dim = x.shape[1]
        p = [rng.standard_normal((dim, hidden)) / math.sqrt(dim), np.zeros(hidden), rng.standard_normal((hidden, parts)) / math.sqrt(hidden), np.zeros(parts)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        t = 0
        for _ in range(rounds if parts > 1 else 0):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 256):
                b = x[order[a : a + 256]]
                h = np.maximum(b @ p[0] + p[1], 0)
                z = h @ p[2] + p[3]
                g = np.exp(z - z.max(1, keepdims=True))
                g /= g.sum(1, keepdims=True)
                g[np.arange(len(b)), part[order[a : a + 256]]] -= 1
                g /= len(b)
                back = (g @ p[2].T) * (h > 0)
                t += 1
                for j, d in enumerate((b.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    d = d + 1e-4 * p[j]
                    m[j] = 0.9 * m[j] + 0.1 * d
                    v[j] = 0.999 * v[j] + 0.001 * d * d
                    p[j] -= 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.p = p

    def order(self, x: np.ndarray) -> np.ndarray:
        """Partitions of each row, the most probable first."""
        x = np.clip((np.clip(x, -1e300, 1e300) * self.unit - self.mean) / self.scale, -1e6, 1e6)
        h = np.maximum(x @ self.p[0] + self.p[1], 0)
        return np.argsort(-(h @ self.p[2] + self.p[3]), axis=1, kind="stable")


def unit(*arrays: np.ndarray) -> float:
    """A power of two that brings the largest component near one, if squares would be out of range; else one."""
    most = max((float(np.abs(x).max()) for x in arrays if x.size), default=1.0)
    return 1.0 if 1e-100 < most < 1e100 or most == 0 else 2.0 ** -math.floor(math.log2(most))


def probes(router: Router, x: np.ndarray, neighbours: np.ndarray, place: np.ndarray, parts: int, recall: float) -> int:
    """The fewest partitions to visit so that rows of x find their neighbours (whose partitions are known) at the recall."""
    order = router.order(x)
    rank = np.empty_like(order)
    rank[np.arange(len(x))[:, None], order] = np.arange(order.shape[1])[None, :]
    needed = rank[np.arange(len(x))[:, None], place[neighbours]]
    return int(min(parts, 1 + np.quantile(needed, recall, method="higher")))


def fit(x: np.ndarray, parts: int, k: int = NEIGHBOURS, recall: float = RECALL) -> tuple[Router, int]:
    """The router of a sample and the number of partitions to visit."""
    # Copies of a vector would be each other's only neighbours in the graph.
    x = np.unique(x, axis=0)
    parts = min(parts, max(1, len(x) // 20))
    if parts < 2:
        return Router(x, np.zeros(len(x), np.int64), 1), 1
    neighbours = _graph(x * unit(x), min(k, len(x) - 1))
    held = np.zeros(len(x), bool)
    held[np.random.default_rng(3).permutation(len(x))[: max(20, len(x) // 5)]] = True
    part = partition(neighbours, parts)
    router = Router(x[~held], part[~held], parts)
    return router, probes(router, x[held], neighbours[held], router.order(x)[:, 0], parts, recall)


def nearest(queries: tuple[np.ndarray, np.ndarray], ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, distance) of each query's k nearest by exact distance, ties to the smaller id."""
    q_ids, q = queries
    out: list[tuple[np.ndarray, ...]] = []
    by = unit(x, q)
    x, q = x * by, q * by
    norm = (x * x).sum(1)
    for a in range(0, len(q), 256):
        block = q[a : a + 256]
        d = norm[None, :] - 2 * block @ x.T + (block * block).sum(1)[:, None]
        for i in range(len(block)):
            d[i, ids == q_ids[a + i]] = np.inf
            row = d[i]
            if len(row) > k:
                edge = np.partition(row, k - 1)[k - 1]
                near = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge)) + 1e-12 * norm.max())
            else:
                near = np.arange(len(row))
            near = near[np.isfinite(row[near])]
            exact = np.sqrt(((x[near] - block[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], exact))[:k]
            out.append((np.full(len(best), q_ids[a + i]), ids[near][best], exact[best] / by))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    return rows


def _matrix(column) -> np.ndarray:
    n = len(column)
    flat = pa.concat_arrays(column.chunks).flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


PLACED = "vec_id long, x array<double>, part long"


def _dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """rows (with part) and the count of chunks of their part, and the chunk of each."""
    counts = rows.groupBy("part").count().select("part", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    return rows.join(counts, "part").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))


def _models(index: DataFrame, sample: int, parts: int, k: int, recall: float) -> DataFrame:
    """(part, model): a router and its visits for each part, fitted on a bounded sample of it."""

    def learn(key, table):
        return pa.table([pa.array([key[0].as_py()]), pa.array([pickle.dumps(fit(_matrix(table["x"]), parts, k, recall))])], names=["part", "model"])

    place = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = index.join(index.groupBy("part").count(), "part").where(place < F.lit(float(sample)) / F.col("count"))
    return cut(some.groupBy("part").applyInArrow(learn, "part long, model binary"))


def _route(rows: DataFrame, models: DataFrame, first: bool, wide: bool, chunk: int) -> DataFrame:
    """rows with the next level's part in place of part: the most probable one, or all to be visited (wide)."""

    def placed(ids, x, part: int, model):
        router, visits = model
        best = router.order(_matrix(x))[:, : visits if wide else 1]
        at = np.repeat(np.arange(len(best)), best.shape[1])
        return [ids.take(pa.array(at)), x.take(pa.array(at)), pa.array(part * MOST + best.ravel())]

    if first:  # one model, a few hundred kilobytes
        model = pickle.loads(models.first()["model"])

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(placed(batch.column("vec_id"), batch.column("x"), 0, model), names=["vec_id", "x", "part"])

        return rows.select("vec_id", "x").mapInArrow(run, PLACED)

    def meet(key, members, model):
        if not members.num_rows or not model.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64())), "part": pa.array([], pa.int64())})
        columns = placed(members["vec_id"].combine_chunks(), members["x"].combine_chunks(), key[0].as_py(), pickle.loads(model["model"][0].as_py()))
        return pa.table(columns, names=["vec_id", "x", "part"])

    rows = _dealt(rows, chunk)
    spread = rows.groupBy(F.col("part").alias("of"), F.col("chunk").alias("nth")).agg(F.first("part").alias("part")).join(models, "part")
    return rows.select("vec_id", "x", "part", "chunk").groupBy("part", "chunk").cogroup(spread.select("of", "nth", "model").groupBy("of", "nth")).applyInArrow(meet, PLACED)


def search(vectors: DataFrame, is_query, k: int = NEIGHBOURS, sample: int = SAMPLE, per_partition: int = PER_PARTITION, recall: float = RECALL, chunk: int = CHUNK, most: int = MOST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found; is_query is a condition on vec_id."""
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], RESULT)
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    rows = rows.where(F.size("x") == dim).withColumn("part", F.lit(0).cast("long"))
    parts = max(1, round(total / per_partition))
    levels = max(1, math.ceil(math.log(parts, most) - 1e-9))
    branch = math.ceil(parts ** (1 / levels) - 1e-9)
    recall = recall ** (1 / levels)  # each level loses its part
    index = rows
    asked = rows.where(is_query).groupBy("vec_id", "part").agg(F.min("x").alias("x"))
    for level in range(levels):
        models = _models(index, sample, branch, k, recall)
        asked = _route(asked, models, level == 0, True, chunk)
        index = cut(_route(index, models, level == 0, False, chunk))
    index = _dealt(index, chunk)
    chunks = index.groupBy(F.col("part").alias("of"), F.col("chunk").alias("nth")).agg(F.first("chunks"))
    asked = asked.join(chunks, asked["part"] == chunks["of"]).select("vec_id", "x", "of", "nth")

    def rank(key, members, queries):
        got = nearest((queries["vec_id"].to_numpy(), _matrix(queries["x"])), members["vec_id"].to_numpy(), _matrix(members["x"]), k) if queries.num_rows and members.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(list(got), names=["query_id", "vec_id", "score"])

    found = index.groupBy("part", "chunk").cogroup(asked.groupBy("of", "nth")).applyInArrow(rank, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
