"""Components by blocks against a flood fill over all voxels, across block faces and with any connectivity."""

from collections import deque

import numpy as np
import pytest

from lamella.operators import relabel


def flood(cells: dict, offsets) -> dict:
    """Least id reachable from each voxel: cells maps (z, y, x) to (label, id)."""
    both = [*offsets, *(tuple(-v for v in o) for o in offsets)]
    out = {}
    for start in sorted(cells, key=lambda c: cells[c][1]):
        if start in out:
            continue
        out[start] = cells[start][1]
        todo = deque([start])
        while todo:
            c = todo.popleft()
            for o in both:
                n = tuple(p + q for p, q in zip(c, o, strict=True))
                if n in cells and n not in out and cells[n][0] == cells[c][0]:
                    out[n] = out[start]
                    todo.append(n)
    return out


@pytest.mark.parametrize("dims,connectivity", [(2, 4), (2, 8), (3, 6), (3, 18), (3, 26)])
def test_blocks_match_flood_fill(spark, monkeypatch, dims, connectivity):
    monkeypatch.setitem(relabel.BLOCK, dims, 4)
    rng = np.random.default_rng(connectivity)
    volume = rng.integers(0, 3, (3, 13, 14)) if dims == 3 else rng.integers(0, 3, (2, 17, 19))
    rows, cells = [], {}
    for place, label in np.ndenumerate(volume):
        place = tuple(v - 5 for v in place)
        lin = len(rows) * 7 % 10007
        rows.append((0, *place, int(label), lin))
        if label:
            cells[place] = (int(label), lin)
    frame = spark.createDataFrame(rows, "sample_id int, z int, y int, x int, label long, lin long")
    got = {r["lin"]: r["component"] for r in relabel.component_labels(frame, ["sample_id"], dims, connectivity).collect()}
    roots = flood(cells, relabel.half_offsets(dims, connectivity))
    order = {r: k + 1 for k, (_, r) in enumerate(sorted({(cells[c][0], r) for c, r in roots.items()}))}
    want = {cells[c][1]: order[r] for c, r in roots.items()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == len(rows)


def test_empty_and_background_only(spark):
    schema = "sample_id int, z int, y int, x int, label long, lin long"
    assert relabel.component_labels(spark.createDataFrame([], schema), ["sample_id"], 3).count() == 0
    got = relabel.component_labels(spark.createDataFrame([(0, 0, 0, 0, 0, 1)], schema), ["sample_id"], 3).collect()
    assert [r["component"] for r in got] == [0]


def test_extra_columns_stay(spark):
    frame = spark.createDataFrame([(0, 0, 0, 0, 1, 1, "a"), (0, 0, 0, 1, 1, 2, "b")], "sample_id int, z int, y int, x int, label long, lin long, _root string")
    got = relabel.component_labels(frame, ["sample_id"], 3).collect()
    assert {(r["_root"], r["component"]) for r in got} == {("a", 1), ("b", 1)}
