"""Hough voting against dense votes, smoothing and all distances, with thousands of peaks."""

import numpy as np
import pytest

from lamella.operators import clustering


def brute(places, offsets, bin_size, sigma, threshold, min_votes):
    bins = np.rint((places + offsets) / bin_size).astype(int)[:, ::-1]  # x first
    bins -= bins.min(0)
    votes = np.zeros(bins.max(0) + 1)
    np.add.at(votes, tuple(bins.T), 1)
    r = int(3 * sigma)
    wide = np.pad(votes, r)
    smooth = np.zeros_like(votes)
    for d in np.ndindex(*[2 * r + 1] * bins.shape[1]):
        smooth += wide[tuple(slice(k, k + n) for k, n in zip(d, votes.shape, strict=True))]
    smooth /= (2 * r + 1) ** bins.shape[1]
    peaks = np.argwhere((smooth >= max(smooth.max() * threshold, min_votes)) & (smooth > 0))
    if not len(peaks):
        return np.zeros(len(bins), int), 0
    out = np.empty(len(bins), int)
    for a in range(0, len(bins), 500):
        out[a : a + 500] = ((bins[a : a + 500, None] - peaks[None]) ** 2).sum(-1).argmin(1) + 1
    return out, len(peaks)


@pytest.mark.parametrize(("dims", "bin_size", "sigma", "threshold", "least"), [(2, 2.0, 1.0, 0.5, 1), (2, 1.0, 0.0, 0.0, 2), (3, 3.0, 0.5, 0.4, 0.1), (2, 2.0, 2.0, 0.3, 1e9)])
def test_hough_labels(spark, dims, bin_size, sigma, threshold, least):
    rng = np.random.default_rng(dims)
    axes = "zyx"[-dims:]
    rows, want = [], {}
    for sample in (0, 1):
        places = rng.integers(0, 40, (700, dims))
        offsets = np.round((rng.integers(0, 4, (700, dims)) * 12 - places) * rng.choice([1.0, 0.9], (700, 1)), 2)
        labels, _ = brute(places, offsets, bin_size, sigma, threshold, least)
        for p, o, label in zip(places.tolist(), offsets.tolist(), labels.tolist(), strict=True):
            want[len(rows)] = label
            rows.append((sample, len(rows), *p, *o))
    df = spark.createDataFrame(rows, f"sample_id int, lin int, {', '.join(f'{a} int' for a in axes)}, {', '.join(f'o{a} double' for a in axes)}").repartition(3)
    got = {r["lin"]: r["label"] for r in clustering.hough_labels(df, ["sample_id"], bin_size, sigma, threshold, least, axes).collect()}
    assert got == want


def test_ten_thousand_peaks(spark):
    rng = np.random.default_rng(1)
    places = np.stack(np.meshgrid(np.arange(110), np.arange(110), indexing="ij"), -1).reshape(-1, 2)
    places = np.concatenate((places, places[rng.random(len(places)) < 0.85]))
    labels, peaks = brute(places, 0.0 * places, 1.0, 0.0, 0.9, 2)
    assert peaks > 9000 or peaks > 0.8 * 12100
    df = spark.createDataFrame([(k, *p, 0.0, 0.0) for k, p in enumerate(places.tolist())], "lin int, y int, x int, oy double, ox double")
    got = {r["lin"]: r["label"] for r in clustering.hough_labels(df, [], 1.0, 0.0, 0.9, 2).collect()}
    assert [got[k] for k in range(len(places))] == labels.tolist()


def test_no_foreground(spark):
    df = spark.createDataFrame([], "sample_id int, lin int, y int, x int, oy double, ox double")
    assert clustering.hough_labels(df, ["sample_id"]).count() == 0
