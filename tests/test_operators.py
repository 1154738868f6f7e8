"""Golden vectors, invariants and brute force for the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import scalar as fn
from lamella.operators import clustering, geometry, losses, metrics, prompts, relabel, selection, stencil, tiling
from lamella.plans.graph import connected_components
from lamella.plans.rank import numbered


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "lin long, label long")


def in_order(df, column="label"):
    return [r[column] for r in df.orderBy("lin").collect()]


def grid(spark, array, extra=0):
    a = np.asarray(array)
    a = a[None] if a.ndim == 2 else a
    rows = [(extra, int(z), int(y), int(x), int((z * a.shape[1] + y) * a.shape[2] + x), int(v)) for (z, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "sample_id int, z int, y int, x int, lin long, label long")


@pytest.mark.parametrize(
    "given, start, want",
    [([0, 5, 0, 5, 12, 12, 0], 1, [0, 1, 0, 1, 2, 2, 0]), ([0] * 10, 1, [0] * 10), ([0, 1, 1, 2, 2, 3, 0], 1, [0, 1, 1, 2, 2, 3, 0]), ([-1, 0, 5, 10], 1, [0, 0, 1, 2]), ([0, 10, 0, 20], 5, [0, 5, 0, 6]), ([42], 1, [1])],
)
def test_relabel_sequential(spark, given, start, want):
    assert in_order(relabel.relabel_sequential(labels(spark, given), start=start)) == want


def pair(spark, pred, gt):
    rows = [(0, i, int(p), int(g)) for i, (p, g) in enumerate(zip(np.ravel(pred), np.ravel(gt), strict=True))]
    return spark.createDataFrame(rows, "sample_id int, lin long, pred long, gt long")


def test_perfect_and_background_metrics(spark):
    same = pair(spark, [[1, 1, 2, 2], [1, 1, 2, 2]], [[1, 1, 2, 2], [1, 1, 2, 2]])
    row = metrics.axi(same, ["sample_id"]).first()
    assert row["ari"] == pytest.approx(1) and row["ami"] == pytest.approx(1) and row["axi"] == pytest.approx(1)
    none = pair(spark, np.zeros((4, 4)), np.zeros((4, 4)))
    row = metrics.axi(none, ["sample_id"]).first()
    assert (row["ari"], row["ami"], row["axi"]) == (0, 0, 0)
    assert metrics.voi(none, ["sample_id"]).first()["voi_total"] == 0


def test_union_foreground(spark):
    rows = pair(spark, [[1, 2], [0, 1]], [[1, 1], [0, 2]])
    assert selection.union_foreground(rows).count() == 3
    assert selection.union_foreground(rows, ignore_background=False).count() == 4


@pytest.mark.parametrize(
    "given, dataset, kwargs, want",
    [
        ([0, 0, 5, 10, 0, 3], "snemi3d", {}, [0, 0, 1, 1, 0, 1]),
        ([0, 500, 1000001, 2000001], "cremi3d", {}, [0, 1, 2, 3]),
        ([0, 500, 1000001, 2000001], "cremi3d", {"ignore": ("cleft", "mitochondria")}, [0, 1, 0, 0]),
        ([0, 1, 2, 1, 0], "mitoem2", {}, [0, 3, 4, 3, 0]),
        ([0, 1, 2, 1, 0], "mitoem2", {"ignore": ("boundary",)}, [0, 3, 0, 3, 0]),
        ([0, 1, 2], "other", {"default": 7}, [0, 7, 7]),
        ([0, 42, 0, 99], "microns", {}, [0, 1, 0, 1]),
    ],
)
def test_class_map(spark, given, dataset, kwargs, want):
    assert in_order(selection.class_ids(labels(spark, given), dataset, **kwargs), "class_id") == want


def test_annotation_modes(spark):
    full = labels(spark, [1, 2, 3, 0]).withColumn("sample_id", F.lit(0))
    part = labels(spark, [1, -100, 2, 0]).withColumn("sample_id", F.lit(1))
    got = {r["sample_id"]: r["mode"] for r in selection.annotation_mode(full.unionByName(part), ["sample_id"]).collect()}
    assert got == {0: "interactive", 1: "fractionary"}
    rows = spark.createDataFrame([(0, 1, 1), (1, -100, -100), (2, 5, 1), (3, 0, 0)], "lin long, label long, sem int")
    out = selection.resolve_partial_labels(rows).orderBy("lin").collect()
    assert [r["label"] for r in out] == [1, 0, 2, 0] and [r["sem"] for r in out] == [1, -100, 1, 0]


def box_labels(shape, *boxes):
    a = np.zeros(shape, int)
    for v, where in boxes:
        a[where] = v
    return a


def test_components(spark):
    two = box_labels((10, 10), (5, np.s_[0:3, 0:3]), (5, np.s_[7:10, 7:10]))
    got = relabel.component_labels(grid(spark, two), ["sample_id"], 2)
    assert got.where("component > 0").select("component").distinct().count() == 2
    corner = np.array([[1, 0], [0, 1]])
    four = relabel.component_labels(grid(spark, corner), ["sample_id"], 2, 4).agg(F.max("component")).first()[0]
    eight = relabel.component_labels(grid(spark, corner), ["sample_id"], 2, 8).agg(F.max("component")).first()[0]
    assert (four, eight) == (2, 1)
    three = box_labels((4, 10, 10), (1, np.s_[:, 0:3, 0:3]), (2, np.s_[:, 7:10, 7:10]))
    assert relabel.component_labels(grid(spark, three), ["sample_id"], 3).agg(F.max("component")).first()[0] == 2
    with pytest.raises(ValueError):
        relabel.component_labels(grid(spark, corner), ["sample_id"], 4)


def test_graph_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[1000 + i] for i in range(200)} == {1000} and 7 not in got
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_numbered(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(7)
    assert all(r["v"] == r["ord"] for r in numbered(rows, ["v"]).collect())


def test_boundary_weight_and_missing_section(spark):
    top = box_labels((16, 16), (1, np.s_[:8]))
    got = stencil.boundary_weight(grid(spark, top), ["sample_id"]).groupBy("y").agg(F.max("weight").alias("w")).collect()
    assert {r["y"] for r in got if r["w"] == 10} == {7, 8}
    ones = grid(spark, np.ones((10, 2, 2), int)).withColumn("intensity", F.col("z").cast("double") ** 2)
    out = {r["z"]: r["intensity"] for r in stencil.fill_missing_sections(ones, [0, 4]).where("y = 0 and x = 0").collect()}
    assert out[4] == (9 + 25) / 2 and out[0] == 0


def brute_edt(mask):
    inside, outside = np.argwhere(mask), np.argwhere(~mask)
    return {tuple(p): np.sqrt(((outside - p) ** 2).sum(1).min()) for p in inside}


def test_edt_and_skeleton(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((9, 11)) < 0.8
    rows = spark.createDataFrame([(0, int(y), int(x), int(mask[y, x]), int(y * 11 + x)) for y, x in np.ndindex(9, 11)], "z int, y int, x int, label long, lin long")
    got = {(r["y"], r["x"]): r["dt"] for r in geometry.distance_transform(rows, ["z"], {"y": 9, "x": 11}).collect()}
    assert got == pytest.approx(brute_edt(mask))
    bar = np.zeros((7, 21), bool)
    bar[1:6, 1:20] = True
    thin = geometry.skeletonize(bar)
    assert 0 < thin.sum() <= 25 and thin[3].sum() >= 9
    ring = np.zeros((11, 11), bool)
    ring[1:10, 1:10] = True
    ring[4:7, 4:7] = False
    loop = geometry.skeletonize(ring)
    assert loop.sum() < ring.sum() and not loop[5, 5]
    # The hole stays closed: its outside cannot be reached from the centre through background edges.
    seen, todo = {(5, 5)}, [(5, 5)]
    while todo:
        y, x = todo.pop()
        for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
            if 0 <= n[0] < 11 and 0 <= n[1] < 11 and not loop[n] and n not in seen:
                seen.add(n)
                todo.append(n)
    assert (0, 0) not in seen
    full = geometry.skeletonize(np.ones((1, 1), bool))
    assert full.all()


def test_gaussian_filter_of_a_constant():
    flat = np.full((12, 9), 3.0)
    assert np.allclose(geometry.gaussian_filter(flat, 1.5, (0, 0)), 3.0)
    ramp = np.tile(np.arange(30.0), (5, 1))
    assert np.allclose(geometry.gaussian_filter(ramp, 1.0, (0, 1))[:, 10:20], 1.0, atol=1e-3)


def test_window_starts():
    assert tiling.window_starts(100, 32, 16, "reference")[-1] + 32 == 96
    assert tiling.window_starts(125, 32, 16, "reference")[-1] + 32 == 112
    assert tiling.window_starts(100, 32, 16)[-1] + 32 == 100
    assert tiling.window_starts(10, 32) == [0]
    assert tiling.overlap_starts(100, 32, 0.25) == [0, 24, 48, 68]


def test_stitching_merges_close_instances(spark):
    lab = np.zeros((1, 8, 16), int)
    lab[:, 2:6, 0:8], lab[:, 2:6, 8:16] = 1, 2
    rows = grid(spark, lab).withColumn("embedding", F.when(F.col("label") > 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    patches = spark.createDataFrame([(0, 0, 0, 0, 1, 8, 10), (1, 0, 0, 6, 1, 8, 16)], "patch_idx int, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    cell = {"z": 1, "y": 8, "x": 10}
    assert tiling.stitch(rows, patches, cell, least=1, spatial_dims=2).where("label > 0").select("label").distinct().count() == 1
    far = rows.withColumn("embedding", F.when(F.col("label") == 2, F.array(F.lit(9.0), F.lit(0.0))).otherwise(F.col("embedding")))
    assert tiling.stitch(far, patches, cell, least=1, spatial_dims=2).where("label > 0").select("label").distinct().count() == 2


def blobs(spark):
    rows = [(i, [1.0 if i < 128 else -1.0] * 8) for i in range(256)]
    return spark.createDataFrame(rows, "lin long, embedding array<double>")


def test_clusters(spark):
    got, modes = clustering.soft_mean_shift(blobs(spark), least=10, iterations=3)
    assert len(modes) == 2 and {r["n"] for r in got.groupBy("cluster").agg(F.count("*").alias("n")).collect()} == {128}
    assert clustering.mean_shift(blobs(spark), least=10).where("cluster > 0").select("cluster").distinct().count() == 2
    none, _ = clustering.soft_mean_shift(blobs(spark), foreground="lin < 0")
    assert none.where("cluster <> 0").count() == 0


def test_losses(spark):
    rows = blobs(spark).withColumns({"sample_id": F.lit(0), "label": F.when(F.col("lin") < 128, 1).otherwise(2).cast("long")})
    got = losses.centroid_embedding_loss(rows, ["sample_id"]).first()
    assert got["l_pull"] == 0 and got["l_push"] == 0 and got["l_reg"] == pytest.approx(np.sqrt(8))
    one = losses.centroid_embedding_loss(rows.where("label = 1"), ["sample_id"]).first()
    assert one["l_push"] == 0
    assert losses.batch_loss(losses.centroid_embedding_loss(rows.where("label = 9"), ["sample_id"]), ["loss"]).first()["loss"] == 0
    with pytest.raises(ValueError):
        fn.regression_kernel("what", F.lit(1.0))


def test_point_prompts_lie_inside(spark):
    lab = box_labels((8, 8), (5, np.s_[:4]))
    rows = grid(spark, lab).withColumn("cls", (F.col("label") > 0).cast("int"))
    got = prompts.sample_points(rows, ["sample_id"], 5, 3).collect()
    assert sorted(r["polarity"] for r in got) == ["neg"] * 3 + ["pos"] * 5
    assert all((r["y"] < 4) == (r["polarity"] == "pos") for r in got)
    assert {(r["target_inst"], r["target_sem"]) for r in got} == {(5, 1)}
    assert prompts.sample_points(rows.where("label = 0"), ["sample_id"]).count() == 0
    two = grid(spark, [[1, 0, 0]]).withColumn("cls", F.col("label").cast("int"))
    assert prompts.sample_points(two, ["sample_id"], 5, 3).where("polarity = 'pos'").count() == 5


def test_parsers(spark):
    row = spark.range(1).select(fn.parse_spacing(F.lit("30,6, 6")).alias("a"), fn.parse_spacing(F.lit("30,6")).alias("b"), fn.parse_ids(F.lit("3, 4")).alias("c"), fn.parse_ids(F.lit("3,x")).alias("d")).first()
    assert row["a"] == [30.0, 6.0, 6.0] and row["b"] is None and row["c"] == [3, 4] and row["d"] == []
