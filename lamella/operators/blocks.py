"""Blocks with halos: a volume cut into boxes, each with copies of the voxels around it.

A voxel belongs to one block and is copied to those whose halo holds it, so whatever depends on neighbours within the
halo is computed block by block, equal for every block size, and no instance has to fit a task.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sides of the blocks, by dimensions.
SIDE = {2: 256, 3: 48}


def block_sides(axes: str, shape: dict[str, int], halo: int, most: int) -> dict[str, int]:
    """Sides of blocks that span `most` places at most with their halos; axes left out are not cut.

    Of the ways to leave axes whole, the one with the fewest copies: (side + 2 * halo) / side for each axis that is cut.
    """
    best = None
    for n in range(len(axes) + 1):
        for whole in combinations(axes, n):
            room, k = most // max(1, math.prod(shape[a] for a in whole)), len(axes) - n
            side = int((room + 0.5) ** (1 / k)) - 2 * halo if k else 1
            if side < 1 or not room:
                continue
            copies = ((side + 2 * halo) / side) ** k if k else 1.0
            if best is None or copies < best[0]:
                best = copies, {a: side for a in axes if a not in whole}
    return best[1] if best else {a: max(1, halo) for a in axes}


def with_halos(rows: DataFrame, axes: str, side: int | dict[str, int], halo: int) -> DataFrame:
    """Each row once for its own block (core) and once for each block whose halo holds it: _blk<axis>, _core.

    side may give a side for each axis; an axis that it leaves out is not cut."""
    sides = side if isinstance(side, dict) else dict.fromkeys(axes, side)
    out = rows
    for a, n in sides.items():
        own = F.floor(F.col(a) / n).cast("long")
        out = out.withColumn(f"_blk{a}", F.explode(F.sequence(F.greatest(F.floor((F.col(a) - halo) / n), F.lit(0)), F.floor((F.col(a) + halo) / n)).cast("array<long>")) if halo else own)
    core = F.lit(True)
    for a, n in sides.items():
        core = core & (F.col(f"_blk{a}") == F.floor(F.col(a) / n))
    return out.withColumns({f"_blk{a}": F.lit(0).cast("long") for a in axes if a not in sides} | {"_core": core})


def block_columns(axes: str) -> list[str]:
    return [f"_blk{a}" for a in axes]


class Dense:
    """The voxels of a block, with its halo, as arrays of the box that they span."""

    def __init__(self, places: np.ndarray):
        self.low = places.min(0)
        self.shape = tuple((places.max(0) + 1 - self.low).tolist())
        self.at = tuple((places - self.low).T)

    def array(self, values: np.ndarray, empty=0) -> np.ndarray:
        out = np.full(self.shape, empty, values.dtype)
        out[self.at] = values
        return out
