"""Ranks, percentiles, expected information and push terms without one task a group, against direct computations."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import aggregates, losses, metrics
from lamella.plans.rank import numbered_within, running_total


def test_places_within_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(None if g == 3 else int(g), int(v)) for g, v in {(g, v) for g, v in zip(rng.integers(0, 4, 500), rng.integers(0, 900, 500), strict=True)}]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = {(r["g"], r["v"]): r["ord"] for r in numbered_within(df, ["g"], ["v"]).collect()}
    for g in {r[0] for r in rows}:
        assert [got[g, v] for v in sorted(v for h, v in rows if h == g)] == list(range(sum(h == g for h, _ in rows)))
    totals = {(r["g"], r["v"]): (r["upto"], r["total"]) for r in running_total(df.withColumn("w", F.col("v") % 7), ["g"], "v", "w").collect()}
    for g in {r[0] for r in rows}:
        upto = 0
        for v in sorted(v for h, v in rows if h == g):
            upto += v % 7
            assert totals[g, v] == (upto, sum(v % 7 for h, v in rows if h == g))
    assert numbered_within(df.limit(0), ["g"], ["v"]).count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 700), rng.integers(0, 60, 700), strict=True)] + [(0, None)]
    got = {r["g"]: r for r in aggregates.rank_percentiles(spark.createDataFrame(rows, "g int, v double").repartition(4), "v", [0.02, 0.5, 0.98], ["g"]).collect()}
    for g in range(3):
        own = sorted(v for h, v in rows if h == g and v is not None)
        assert [got[g][c] for c in ("p02", "p50", "p98")] == [own[min(int(len(own) * s), len(own) - 1)] for s in (0.02, 0.5, 0.98)]


def plain_ami(pred, gt):
    n, a, b, both = len(pred), Counter(pred), Counter(gt), Counter(zip(pred, gt, strict=True))
    if len(a) == len(b) == 1:
        return 1.0
    mi = sum(k / n * math.log(n * k / (a[i] * b[j])) for (i, j), k in both.items())
    emi = 0.0
    for x in a.values():
        for y in b.values():
            for k in range(max(1, x + y - n), min(x, y) + 1):
                emi += k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y)
    h = [-sum(v / n * math.log(v / n) for v in c.values()) for c in (a, b)]
    return max(0.0, (mi - emi) / (sum(h) / 2 - emi))


def test_ami_against_exact_combinations(spark, monkeypatch):
    monkeypatch.setattr(metrics, "TERMS", 7)
    rng = np.random.default_rng(2)
    samples = {0: (rng.integers(0, 5, 300), rng.integers(0, 4, 300)), 1: (rng.integers(1, 9, 80),) * 2, 2: (np.ones(20, int), np.ones(20, int)), 3: (np.arange(1, 31), np.arange(1, 31) // 4 + 1)}
    rows = [(s, int(p), int(g)) for s, (pred, gt) in samples.items() for p, g in zip(pred, gt, strict=True)] + [(4, 0, 0)]
    got = {r["sample_id"]: r["ami"] for r in metrics.ami(spark.createDataFrame(rows, "sample_id int, pred long, gt long").repartition(4), ["sample_id"]).collect()}
    for s in samples:
        own = [(p, g) for t, p, g in rows if t == s and (p > 0 or g > 0)]
        assert got[s] == pytest.approx(plain_ami(*zip(*own, strict=True)), abs=1e-9)
    assert got[4] == 0


def test_large_factorials_and_terms():
    for x in (0, 1, 7, 255, 256, 1000, 10**6, 10**9):
        assert metrics.log_factorial(np.array([x]))[0] == pytest.approx(math.lgamma(x + 1), rel=1e-14, abs=1e-12)
    x, y, n = 300, 200, 1000
    want = sum(k / n * math.log(n * k / (x * y)) * math.comb(x, k) * math.comb(n - x, y - k) / math.comb(n, y) for k in range(1, 201))
    mean, wide = x * y / n, math.sqrt(373 * 200) + 2
    assert metrics.expected_terms(x, y, n, max(1, math.floor(mean - wide)), min(200, math.ceil(mean + wide)) + 1) == pytest.approx(want, rel=1e-10)


def test_push_by_range_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), k, v.tolist()) for k, (s, v) in enumerate(zip(rng.integers(0, 3, 400), np.round(rng.normal(0, 4, (400, 3)), 2), strict=True))]
    rows += [(0, 900, rows[0][2]), (0, 901, rows[0][2]), (7, 902, [0.0, 0.0, 0.0])]
    means = spark.createDataFrame(rows, "sample_id int, label int, mean array<double>").repartition(4)
    packed = {r["sample_id"]: r["push"] for r in losses.push_term(means, ["sample_id"], 1.5).collect()}
    ranged = {r["sample_id"]: r["push"] for r in losses.push_term(means, ["sample_id"], 1.5, packed=0).collect()}
    for s in range(3):
        x = np.array([r[2] for r in rows if r[0] == s])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[np.triu_indices(len(x), 1)]
        assert packed[s] == pytest.approx((np.maximum(3 - d, 0) ** 2).mean()) == ranged[s]
    assert 7 not in packed and 7 not in ranged


def test_many_instances_in_one_sample(spark):
    """20,000 instances, two hundred million pairs, of which few are in range."""
    grid = spark.range(20000).select(F.lit(0).alias("sample_id"), F.col("id").alias("label"), F.array((F.col("id") % 200) * 1.0, F.floor(F.col("id") / 200) * 1.0).alias("mean"))
    got = losses.push_term(grid, ["sample_id"], 0.75).first()["push"]
    sides = 199 * 100 + 200 * 99  # neighbours at distance 1, diagonals at the root of 2
    want = (sides * 0.25 + 2 * 199 * 99 * (1.5 - math.sqrt(2)) ** 2) / (20000 * 19999 / 2)
    assert got == pytest.approx(want, rel=1e-6)


def test_losses_of_classes_and_totals(spark):
    rows = spark.createDataFrame([(0, 1, 1, [0.0, 1.0], 1.0), (0, 1, 1, [0.0, 3.0], 2.0), (0, 2, 2, [5.0, 0.0], 1.0), (1, 3, 1, [1.0, 1.0], 1.0), (1, 0, 3, [9.0, 9.0], 1.0)], "sample_id int, label int, class_id int, embedding array<double>, weight double")
    per = {r["sample_id"]: r for r in losses.instance_loss(rows, ["sample_id"]).collect()}
    centre = (1 + 3 * 2) / (3 + 1e-8)
    pull = ((max(abs(1 - centre) - 0.5, 0) ** 2 * 1 + max(abs(3 - centre) - 0.5, 0) ** 2 * 2) / 2 + 0) / 2
    assert per[0]["pull"] == pytest.approx(pull) and per[1]["push"] == 0
    assert per[0]["loss"] == pytest.approx(per[0]["pull"] + per[0]["push"] + 0.001 * per[0]["norm"])
    by_class = losses.instance_loss_by_class(rows, ["sample_id"]).first()
    # classes 1 (two samples), 2 (one) and 3 (no instance)
    assert by_class["pull"] == pytest.approx((pull * 2 / 2 + 0 + 0) / 3)
    sem = spark.createDataFrame([(0, 1.0, 2.0), (1, 0.5, 3.0)], "sample_id int, ce double, loss double")
    ins = losses.instance_loss(rows.where("sample_id = 0"), ["sample_id"])
    out = {(r["sample_id"], r["key"]): r["value"] for r in losses.combined_loss(sem, ins, ["sample_id"], sem, (1.0, 2.0, 0.0)).collect()}
    assert out[0, "loss"] == pytest.approx(2.0 + 2 * per[0]["loss"]) and out[1, "loss"] == 3.0 and out[1, "loss_ins/pull"] == 0 and (0, "loss_geom") not in out
