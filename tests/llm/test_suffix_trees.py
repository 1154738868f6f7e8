"""Vertical partitioning, front coding and deep nodes against plain versions."""

import collections

import numpy as np
import pytest

from lamella.llm import substring_dedup as trees


@pytest.mark.parametrize("groups", [1, 64, 2_100, 30_000, 10_000_000])
def test_every_suffix_has_one_prefix_group(groups):
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    words = vocabulary[np.minimum(rng.zipf(1.3, 20_000), 5000) - 1]
    counts = np.bincount((words % np.uint64(trees.CLASSES)).astype(np.int64), minlength=trees.CLASSES)
    parts = trees.Partitions(counts, groups, 13)
    starts = np.arange(len(words) - 12)
    n, group = parts.lengths(words, starts), parts.of(words, starts)
    prefixes = [tuple(words[s : s + k].tolist()) for s, k in zip(starts.tolist(), n.tolist(), strict=True)]
    by = {}
    for p, g in zip(prefixes, group.tolist(), strict=True):
        assert by.setdefault(p, g) == g  # the prefix decides the group
    known = set(prefixes)
    assert not any(p[:k] in known for p in known for k in range(1, len(p)))  # and no prefix starts another
    if groups <= 30_000:
        assert n.max() < 13  # no suffix had to take its whole window
        most = collections.Counter(prefixes).most_common(1)[0][1]
        assert most <= 40 + 4 * len(starts) / groups
    assert n.min() >= 1


def test_front_coding_and_nodes():
    rng = np.random.default_rng(2)
    heads, tails = rng.integers(0, 3, (500, 3)), rng.integers(0, 2**63, 2, dtype=np.uint64)[rng.integers(0, 2, 500)]
    names = np.sort(rng.integers(0, 2**40, 3, dtype=np.uint64))
    docs = rng.integers(-5, 5, 500)
    order, common = trees.sort_suffixes(heads.astype(np.int32), tails, 13, 3)
    rows = [(*h, int(t)) for h, t in zip(heads.tolist(), tails.tolist(), strict=True)]
    assert order.tolist() == sorted(range(500), key=lambda k: (rows[k], k))
    for k in range(1, 500):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert common[k] == (13 if a == b else next((c for c in range(3) if a[c] != b[c]), 3))
    back = trees.front_decoded(trees.front_coded(heads[order], tails[order], common, names, docs[order]), 3)
    assert np.array_equal(names[heads[order]], back[0][back[1]]) and np.array_equal(back[2], tails[order]) and np.array_equal(back[3], docs[order])
    node = trees.deep_nodes(common, 13)
    assert node[-1] + 1 == len(set(rows))
