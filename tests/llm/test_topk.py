"""Exact search by inner product against all pairs, for lengths of every kind."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import topk

VECTORS = "vec_id long, embedding array<double>, label int, x string, bucket int, chunk int, bound int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 1, "x", 1, 2, 3) for i, v in rows], VECTORS)


def usable(rows):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = Counter(len(v) for _, v in ok)
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    return [(i, [math.floor(256 * x) for x in v]) for i, v in ok if len(v) == dim]


def brute(rows, k=5, every=50):
    rows = usable(rows)
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        x = min(v for i, v in rows if i == q)
        best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, v, strict=True)))), i) for i, v in rows if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def found(df, k=5, every=50, **sizes):
    return sorted(tuple(r) for r in topk.search(topk.whole(df), F.col("vec_id") % every == 0, k, **sizes).collect())


def test_against_all_pairs_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 6)) * np.exp(rng.normal(0, 1.5, 400))[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[3][1]), (100, rows[9][1]), (50, rows[50][1]), (900, [0.0] * 6), (901, [0.0] * 6), (-50, [1.0, 0, 0, 0, 0, -0.001])]
    rows += [(902, None), (950, [1.0, None, 0, 0, 0, 0]), (951, [math.nan] * 6), (1000, [math.inf] * 6), (None, [1.0] * 6), (953, [1.0]), (954, [])]
    rows += [(2000 + i, [3.0, 2, 1, 0, 0, 0]) for i in range(150)]  # many ties
    df = table(spark, rows).repartition(3)
    assert found(df) == brute(rows)
    assert found(df, head=10, chunk=40, block=3) == brute(rows)
    assert found(df, k=3, every=7, head=4, chunk=64, block=16) == brute(rows, 3, 7)


def test_products_beyond_doubles(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.integers(0, 12)).tolist()) for i in range(60)] + [(100, [1e300, 0, 0]), (101, [0, 1e14, 1e14])]
    assert found(table(spark, rows), every=10) == brute(rows, every=10)


def test_both_ways_of_pruning_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 5))
    x = np.rint(x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(270, 300, 3000)[:, None])
    q = np.rint(np.concatenate((x[:40] * 2, rng.standard_normal((40, 5)) * 300)))
    bucket, ids = topk.Bucket(np.arange(3000), x), np.arange(80) + 10_000
    scores = q @ x.T
    bounds = np.sort(scores, axis=1)[:, -20]
    bounds[::3] = -1
    got = topk.best_of(bucket, ids, q, bounds, 20)
    assert set(got[3]) == {"coordinate", "length"}
    for i in range(80):
        want = sorted((-s, p) for p, s in enumerate(scores[i]))[:20]
        assert [(-s, v) for a, v, s in zip(*got[:3], strict=True) if a == ids[i]] == [(int(s), p) for s, p in want]


def test_few_rows_and_empty(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(0, [1.0, 2.0])])) == []
    assert found(table(spark, [(1, [1.0, 2.0])])) == []
    rows = [(0, [1.0, 2.0]), (50, [-1.0, 0.5]), (3, [0.0, 0.0])]
    assert found(table(spark, rows)) == brute(rows)


@pytest.mark.parametrize("bucket", [-topk.EDGE, 0, 37, topk.EDGE])
def test_bound_of_a_bucket(bucket):
    assert topk._upper(bucket) >= (0 if bucket == -topk.EDGE else (1 / topk.RATIO) ** min(bucket, 900))
