"""Seeded augmentation: the same rows at any partitioning, moments, and each step against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import augment
from lamella.operators.geometry import gaussian_filter

SHAPE = {"y": 9, "x": 12}


def frame(spark, samples=40, parts=3):
    rows = [(s, y, x, float((s * 31 + y * 17 + x * 5) % 23), s * 1000 + y * 12 + x) for s in range(samples) for y in range(9) for x in range(12)]
    return spark.createDataFrame(rows, "sample_id int, y int, x int, intensity double, lin int").repartition(parts)


def chain(seed=3):
    return augment.Chain(["sample_id"], SHAPE, seed).scale().flip("y").rot90().flip("x").noise(0.5).contrast(0.5)


def test_same_seed_same_rows(spark):
    one = sorted(tuple(r) for r in chain().apply(frame(spark)).collect())
    two = sorted(tuple(r) for r in chain().apply(frame(spark, parts=7).orderBy(F.desc("lin"))).collect())
    other = sorted(tuple(r) for r in chain(4).apply(frame(spark)).collect())
    assert one == two and one != other and len(one) == 40 * 108


def test_places_are_turned_and_flipped_as_wholes(spark):
    got = {}
    for r in augment.Chain(["sample_id"], SHAPE, 5).flip("y").rot90(0.7).flip("x").apply(frame(spark)).collect():
        got.setdefault(r["sample_id"], {})[r["y"], r["x"]] = r["lin"]
    seen = set()
    for s, cells in got.items():
        lin = s * 1000 + np.arange(108).reshape(9, 12)
        options = {}
        for a in (0, 1):
            for k in range(4):
                for b in (0, 1):
                    m = np.rot90(lin[::-1] if a else lin, k)
                    options[(m[:, ::-1] if b else m).tobytes(), m.shape] = (a, k, b)
        shape = tuple(max(p[n] for p in cells) + 1 for n in (0, 1))
        have = np.empty(shape, lin.dtype)
        for p, v in cells.items():
            have[p] = v
        seen.add(options[have.tobytes(), shape])
    assert len(seen) > 6


def test_moments_of_the_draws(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    u, n = augment.uniform(1, "a", "k"), augment.normal(1, "b", "k")
    assert abs(df.agg(F.avg(n)).first()[0]) < 0.03 and abs(df.agg(F.avg(u)).first()[0] - 0.5) < 0.01
    got = df.agg(F.avg(u), F.var_pop(u), F.avg(n), F.var_pop(n), F.kurtosis(n), F.corr(u, augment.uniform(1, "c", "k"))).first()
    assert list(got) == pytest.approx([0.5, 1 / 12, 0, 1, 0, 0], abs=0.15)
    flips = augment.Chain(["sample_id"], SHAPE, 9).flip("y", 0.3).apply(frame(spark, 600)).where("y = 0 and x = 0").select((F.col("lin") % 1000 > 50).cast("int").alias("on"))
    assert flips.agg(F.avg("on")).first()[0] == pytest.approx(0.3, abs=0.06)
    noisy = augment.Chain(["sample_id"], SHAPE, 2).noise(1.0, 0.5, 0.2).apply(frame(spark, 200).withColumn("intensity", F.lit(0.0)))
    mean, spread = noisy.agg(F.avg("intensity"), F.stddev("intensity")).first()
    assert mean == pytest.approx(0.5, abs=0.01) and spread == pytest.approx(0.2 / np.sqrt(3), abs=0.02)


def test_displacement_field_is_smoothed_noise(spark):
    samples = spark.createDataFrame([(s,) for s in range(3)], "sample_id int")
    got = augment.displacement_field(samples, ["sample_id"], (30, 22), 2.0, 10.0, 4).collect()
    noise = {}
    raw = samples.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(21)))).withColumns({n: 2.0 * augment.uniform(4, f"elastic/{n}", "sample_id", "y", "x") - 1.0 for n in ("dy", "dx")})
    for r in raw.collect():
        for n in ("dy", "dx"):
            noise.setdefault((r["sample_id"], n), np.zeros((30, 22)))[r["y"], r["x"]] = r[n]
    want = {k: gaussian_filter(v, 2.0, (0, 0)) * 10 for k, v in noise.items()}
    assert len(got) == 3 * 660
    for r in got:
        assert [r["dy"], r["dx"]] == pytest.approx([want[r["sample_id"], n][r["y"], r["x"]] for n in ("dy", "dx")])


def test_elastic_moves_whole_samples(spark):
    rows = frame(spark, 30).withColumn("z", F.lit(0))
    got = augment.elastic(rows, ["sample_id"], (9, 12), ["lin"], 2.0, 30.0, 0.5, 6).collect()
    assert len(got) == 30 * 108 and len({(r["sample_id"], r["y"], r["x"]) for r in got}) == 30 * 108
    same = {s: all(r["lin"] == s * 1000 + r["y"] * 12 + r["x"] for r in got if r["sample_id"] == s) for s in range(30)}
    assert 6 < sum(same.values()) < 24
    fields = {(r["sample_id"], r["y"], r["x"]): (r["dy"], r["dx"]) for r in augment.displacement_field(rows, ["sample_id"], (9, 12), 2.0, 30.0, 6).collect()}
    for r in got:
        if not same[r["sample_id"]]:
            dy, dx = fields[r["sample_id"], r["y"], r["x"]]
            y, x = int(min(max(r["y"] + dy, 0), 8)), int(min(max(r["x"] + dx, 0), 11))
            assert r["lin"] == r["sample_id"] * 1000 + y * 12 + x


@pytest.mark.parametrize("size", [{"y": 5, "x": 31}, {"y": 9, "x": 1}, {"y": 30, "x": 12}])
def test_linear_resize(spark, size):
    rows = frame(spark, 2)
    got = {(r["sample_id"], r["y"], r["x"]): r["intensity"] for r in augment.resize_linear(rows, ["sample_id"], SHAPE, size).collect()}
    for s in (0, 1):
        m = np.array([[(s * 31 + y * 17 + x * 5) % 23 for x in range(12)] for y in range(9)], float)
        for axis, (old, new) in enumerate(((9, size["y"]), (12, size["x"]))):
            at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
            low = np.minimum(np.floor(at).astype(int), old - 1)
            part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
            m = np.take(m, low, axis) * (1 - part) + np.take(m, np.minimum(low + 1, old - 1), axis) * part
        for p in np.ndindex(*m.shape):
            assert got[s, *p] == pytest.approx(m[p])
    assert len(got) == 2 * size["y"] * size["x"]
