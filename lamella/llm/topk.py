"""Exact top-k search by inner product: buckets of similar length, pruned by local cosine thresholds.

Vectors are grouped by length into buckets whose shortest is 0.9 times as long as the longest (a bucket is the whole part
of a logarithm, so no sort is needed), and a bucket is dealt in chunks of CHUNK rows. A query that has k products of at
least t needs from a bucket whose longest vector has length l only vectors whose cosine with it is t / (|q| l) or more.

1. Each query takes its first t from the HEAD longest vectors of all (a fixed number, a few megabytes at most).
2. Queries in blocks of BLOCK meet the chunks of those buckets whose threshold can be reached: t <= |q| l.
3. In a chunk every query prunes in the way that leaves fewer vectors: by length (vectors stand in order of length; only
   those with |q| |p| >= t are multiplied) or by coordinate (for the query's largest coordinates the cosine threshold
   bounds the coordinate of a unit vector to an interval; sorted coordinates give the vectors inside). What is left is
   multiplied exactly.
4. A query's best of all chunks are ranked. Only rows that reach its first t come that far.

All bounds are widened by more than the rounding of lengths and cosines, so they never cost a result; products are taken on
whole numbers, in doubles where they are exact there (below 2**53), else in integers of any size. A product beyond the range
of long counts as the nearest long.

Vectors that are null, that hold null or non-finite components or that have a null vec_id take no part; neither do those
whose number of components is not the commonest one (of equals, the least), as there is no product. Zero vectors take
part. Rows with the query's vec_id are its own; of different query vectors under one vec_id the least (component by
component) asks, and repeated rows are candidates of their own, so that a vec_id may stand in a result twice. Equal scores
are ordered by vec_id. Extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Longest vectors that set the first thresholds, rows of a chunk of candidates and of a block of queries.
HEAD, CHUNK, BLOCK = 1024, 8192, 4096
#: Components that a chunk or a block holds at most (32 MB of doubles); of longer vectors it has fewer rows.
CELLS = 1 << 22
#: Shortest to longest of a bucket, coordinates that a query prunes by, and what a bound is widened by.
RATIO, FOCUS, SLACK = 0.9, 4, 1e-9
#: Cosines from which intervals of coordinates can leave out anything worth a search.
STEEP = 0.3

#: Bucket of zero vectors (-EDGE) and of those whose length a double does not hold.
EDGE = 10**6

RESULT = "query_id long, rank int, vec_id long, score long"
_LONG = 2**63 - 1


def whole(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part: floor(factor * component)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    # rint(y) - 1 where that lies above y: floor() itself returns a long, which large components leave
    y = lambda v: v * F.lit(factor)
    return rows.select("vec_id", F.transform("x", lambda v: F.rint(y(v)) - F.when(F.rint(y(v)) > y(v), 1.0).otherwise(0.0)).alias("x")).where(F.forall("x", lambda v: F.abs(v) < float("inf")))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, rows of q by rows of x, exact: doubles if all stay below 2**53, else objects."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return q @ x.T
    whole_q, whole_x = (np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (q, x))
    return np.maximum(np.minimum(whole_q.dot(whole_x.T), _LONG), -_LONG - 1)


def lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0)
    scale = np.where(most > 0, most, 1.0)
    return np.sqrt(((x / scale[:, None]) ** 2).sum(1)) * scale


class Bucket:
    """Vectors of a chunk, the longest first, and their unit coordinates in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        by = np.argsort(-lengths(x), kind="stable")
        self.ids, self.x = ids[by], x[by]
        self.length = lengths(self.x)
        self.unit = self.x / np.where(self.length > 0, self.length, 1.0)[:, None]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the vectors by their f-th unit coordinate, and these coordinates."""
        if f not in self._sorted:
            by = np.argsort(self.unit[:, f], kind="stable")
            self._sorted[f] = by, self.unit[by, f]
        return self._sorted[f]

    def by_length(self, length: float, bound: float) -> int:
        """How many vectors, the longest, can have a product of at least bound with a query of that length."""
        if bound <= 0 or length == 0:
            return len(self.ids) if bound <= 0 else 0
        return int(np.searchsorted(-self.length, -(bound / length) * (1 - SLACK), "right"))

    def by_coordinate(self, q: np.ndarray, length: float, bound: float, most: int) -> np.ndarray | None:
        """Places of the vectors whose coordinates allow the product, if these are fewer than half of most."""
        if bound <= 0 or length == 0 or not len(self.ids) or self.length[0] == 0:
            return None
        cosine = bound / (length * self.length[0]) * (1 - SLACK)
        if cosine < STEEP:
            return None
        cosine, unit = min(cosine, 1.0), q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        spread = np.sqrt(np.maximum(0, (1 - cosine * cosine) * (1 - unit[focus] ** 2))) + 1e-7
        # all cosines of angle(coordinate axis, query) -/+ angle(threshold), up to the axis itself if that lies between
        low = np.where(-unit[focus] >= cosine, -1.0, unit[focus] * cosine - spread) - SLACK
        high = np.where(unit[focus] >= cosine, 1.0, unit[focus] * cosine + spread) + SLACK
        spans = []
        for f, a, b in zip(focus.tolist(), low, high, strict=True):
            _, values = self.coordinate(f)
            spans.append((int(np.searchsorted(values, a, "left")), int(np.searchsorted(values, b, "right"))))
        best = min(range(len(spans)), key=lambda i: spans[i][1] - spans[i][0])
        if 2 * (spans[best][1] - spans[best][0]) >= most:
            return None
        at = self.coordinate(int(focus[best]))[0][spans[best][0] : spans[best][1]]
        inside = ((self.unit[np.ix_(at, focus)] >= low) & (self.unit[np.ix_(at, focus)] <= high)).all(1)
        return at[inside]


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score, then by id."""
    if len(scores) > 4 * k and scores.dtype != object:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.array(sorted(range(len(near)), key=lambda i: (-scores[near[i]], ids[near[i]]))[:k], dtype=np.int64)]


def best_of(bucket: Bucket, q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int) -> tuple[list, list, list, list]:
    """(query_id, vec_id, score) of each query's k best in the bucket that reach its bound, and how each query pruned."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    size = lengths(q)
    plain: dict[int, int] = {}

    def take(i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= bounds[i]) & (ids != q_ids[i])
        scores, ids = scores[ok], ids[ok]
        for p in _top(scores, ids, k).tolist():
            out[0].append(int(q_ids[i]))
            out[1].append(int(ids[p]))
            out[2].append(int(scores[p]))

    for i in range(len(q)):
        most = bucket.by_length(float(size[i]), float(bounds[i]))
        at = bucket.by_coordinate(q[i], float(size[i]), float(bounds[i]), most) if most else None
        if at is None:
            plain[i] = most
        else:
            out[3].append("coordinate")
            if len(at):
                take(i, products(q[i : i + 1], bucket.x[at])[0], bucket.ids[at])
    by = sorted((i for i in plain if plain[i]), key=lambda i: -plain[i])
    out[3].extend("length" for _ in plain)
    for a in range(0, len(by), 128):
        block = by[a : a + 128]
        got = products(q[block], bucket.x[: plain[block[0]]])
        for row, i in zip(got, block, strict=True):
            take(i, row[: plain[i]], bucket.ids[: plain[i]])
    return out


def search(vectors: DataFrame, is_query, k: int = 5, head: int = HEAD, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """RESULT: the k largest inner products of each query (is_query: a condition on vec_id) with all other rows.

    vectors: vec_id and x, an array of whole doubles, as whole() gives them.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn("dim", F.size("x")).withColumn("long", F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)))
    bucket = F.when(F.col("long") > 0, F.floor(F.log("long") / F.lit(-math.log(RATIO)))).otherwise(F.lit(-EDGE))
    rows = rows.withColumn("bucket", F.least(bucket, F.lit(EDGE)).cast("int"))
    counts = rows.groupBy("dim", "bucket").count().collect()  # whole numbers within doubles: some thousands of buckets
    total: dict[int, int] = {}
    for r in counts:
        total[r["dim"]] = total.get(r["dim"], 0) + r["count"]
    if not total:
        return spark.createDataFrame([], RESULT)
    dim = min(total, key=lambda d: (-total[d], d))
    head, chunk, block = (max(k + 1, min(n, CELLS // max(dim, 1))) for n in (head, chunk, block))
    rows = rows.where(F.col("dim") == dim)
    chunks = {r["bucket"]: -(-r["count"] // chunk) for r in counts if r["dim"] == dim}

    longest = rows.orderBy(F.desc("long"), "vec_id", "x").limit(head).select("vec_id", "x").toArrow()
    first = longest["vec_id"].to_numpy(), matrix(longest["x"])
    upper = sorted((b, _upper(b)) for b in chunks)

    def bounded(batches):
        """Queries with their first bound (the k-th product among the longest) and the least bucket that can reach it."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, q = batch.column("vec_id").to_numpy(), matrix(batch.column("x"))
            size, bounds, least = lengths(q), [], []
            for a in range(0, len(ids), 256):
                for j, scores in enumerate(products(q[a : a + 256], first[1]), a):
                    scores = sorted(scores[first[0] != ids[j]].tolist())
                    bound = float(scores[-k]) if len(scores) >= k else -math.inf
                    bounds.append(bound - 1e-12 * abs(bound) if bound > -math.inf else bound)  # integers may lie between doubles
                    least.append(next((b for b, most in upper if bounds[-1] <= 0 or size[j] * most * (1 + SLACK) >= bounds[-1]), EDGE + 1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(bounds, pa.float64()), pa.array(least, pa.int32())], names=["vec_id", "x", "bound", "least"])

    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    n_asked = rows.where(is_query).select("vec_id").distinct().count()
    if not n_asked:
        return spark.createDataFrame([], RESULT)
    blocks = -(-n_asked // block)
    deal = F.broadcast(spark.createDataFrame(sorted(chunks.items()), "bucket int, chunks int"))  # a row a bucket
    asked = asked.mapInArrow(bounded, "vec_id long, x array<double>, bound double, least int")
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("bucket", F.explode(F.filter(F.array(*(F.lit(b) for b, _ in upper)), lambda b: b >= F.col("least")))).join(deal, "bucket")
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    salt = F.xxhash64("vec_id", F.monotonically_increasing_id())  # rows of one vec_id need not share a chunk
    members = rows.withColumn("salt", salt).join(deal, "bucket").withColumn("chunk", F.pmod("salt", "chunks").cast("int"))
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["bucket", "chunk", "block"]

    def rank(_key, left, right):
        got: tuple = ([], [], [])
        if left.num_rows and right.num_rows:
            got = best_of(Bucket(left["vec_id"].to_numpy(), matrix(left["x"])), right["vec_id"].to_numpy(), matrix(right["x"]), right["bound"].to_numpy(), k)[:3]
        return pa.table([pa.array(c, pa.int64()) for c in got], names=["query_id", "vec_id", "score"])

    found = members.select("vec_id", "x", *keys).groupBy(*keys).cogroup(asked.select("vec_id", "x", "bound", *keys).groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _upper(bucket: int) -> float:
    """No vector of the bucket is longer."""
    if bucket == -EDGE:
        return 0.0
    return math.inf if bucket == EDGE else (1 / RATIO) ** (bucket + 1) * (1 + 1e-6)
