import json

import numpy as np
import pytest

from lamella.operators.browser import canvas_scale, canvas_to_voxel
from lamella.sources import datasets
from lamella.sources.formats import save_volume


def test_declarations():
    assert datasets.Cremi3D.info.resolution_tuple() == (40, 4, 4)
    assert datasets.Snemi3D.info.anisotropy() == 5.0
    assert datasets.evenly_spaced(100, 3) == [0, 50, 99]
    assert canvas_scale((100, 100), [(50, 20), (10, 40)]) == 2.0
    assert canvas_to_voxel((10, 20), (0, 0), 2.0, (1.0, 1.0), (50, 50)) == (10, 5)
    assert canvas_to_voxel((-1, 0), (0, 0), 1.0, (1.0, 1.0), (5, 5)) is None


def test_snemi_and_microns(spark, tmp_path):
    raw = np.arange(60.0).reshape(5, 3, 4)
    save_volume(raw, str(tmp_path / "AC4_inputs.npy"))
    save_volume((raw % 3).astype("i8"), str(tmp_path / "AC4_labels.npy"))
    rows = datasets.Snemi3D(str(tmp_path)).rows(spark, "train").orderBy("z", "y", "x").collect()
    assert rows[-1]["intensity"] == 1.0 and [r["label"] for r in rows[:4]] == [0, 1, 2, 0]
    with pytest.raises(FileNotFoundError):
        datasets.Snemi3D(str(tmp_path)).rows(spark, "test")
    save_volume(raw, str(tmp_path / "volume.npy"))
    save_volume(raw.astype("i8"), str(tmp_path / "segmentation.npy"))
    m = datasets.Microns(str(tmp_path), 0.4)
    assert {r["z"] for r in m.rows(spark, "train").select("z").distinct().collect()} == {0, 1, 2}
    assert m.slices(spark, "valid").count() == 2


def test_cremi_fuses_and_stacks(spark, tmp_path):
    for name in "AB":
        save_volume(np.zeros((2, 2, 2)), str(tmp_path / f"sample_{name}_raw.npy"))
        save_volume(np.full((2, 2, 2), 7, "i8"), str(tmp_path / f"sample_{name}_neuron.npy"))
    mito = np.zeros((2, 2, 2), "i8")
    mito[0, 0, 0] = 3
    save_volume(mito, str(tmp_path / "sample_B_mito.npy"))
    d = datasets.Cremi3D(str(tmp_path), train_share=0.5)
    assert {r["label"] for r in d.rows(spark, "train").collect()} == {7}
    assert {(r["z"], r["label"]) for r in d.rows(spark, "valid").collect()} == {(2, 7), (2, 2_000_003), (3, 7)}


def test_cremi_in_one_file(spark, tmp_path):
    ids = np.full((2, 2, 2), 9, "u8")
    none = np.full((2, 2, 2), 2**64 - 1, "u8")
    none[1, 1, 1] = 4
    np.savez(tmp_path / "sample_A.npz", **{"volumes/raw": np.arange(8.0).reshape(2, 2, 2), "volumes/labels/neuron_ids": ids, "volumes/labels/clefts": none})
    (tmp_path / "B").mkdir()
    np.savez(tmp_path / "B" / "sample.npz", **{"raw": np.zeros((2, 2, 2)), "neuron_ids": ids})
    d = datasets.Cremi3D(str(tmp_path), train_share=0.5)
    assert d.sample("A")["cleft"][1] == "volumes/labels/clefts" and d.sample("C") == {}
    got = {(r["z"], r["y"], r["x"]): (r["label"], r["intensity"]) for r in d.rows(spark, "train").collect()}
    assert len(got) == 8 and got[1, 1, 1] == (1_000_004, 1.0) and got[0, 0, 0] == (9, 0.0)
    assert {r["label"] for r in d.rows(spark, "valid").collect()} == {9}


def test_mitoem(spark, tmp_path):
    for k in range(3):
        save_volume(np.full((4, 3, 2), k, "i2"), str(tmp_path / f"imagesTr/c{k}_0000.nii.gz"))
    save_volume(np.ones((4, 3, 2), "u1"), str(tmp_path / "labelsTr/c0.nii.gz"))
    (tmp_path / "dataset.json").write_text(json.dumps({"spacing": [30, 8, 8]}))
    d = datasets.MitoEM2(str(tmp_path), 0.34)
    assert d.spacing() == [30, 8, 8] and [len(d.cases(s)) for s in ("train", "valid", "test")] == [1, 2, 3]
    assert d.rows(spark, "train").where("label = 1").count() == 24 and d.slice_axis((4, 3, 2)) == 2
    missing = datasets.missing_files(spark, ["imagesTr/c0_0000.nii.gz", "imagesTr/c9_0000.nii.gz"], str(tmp_path))
    assert [r["path"] for r in missing.collect()] == ["imagesTr/c9_0000.nii.gz"]
