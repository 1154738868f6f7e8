"""Passes along the lines of a volume: every line of voxels is a stream of its own, whatever instances it crosses.

Rows that share all coordinates but one form a line. Lines are dealt by hash and sorted by their free axis; a task takes
whole lines, many at once, so a step holds a batch and the longest line (a side of the volume), never an instance. Axes
whose sides span at most PLANE places together are dealt as one (planes), and their passes follow one another in a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Stands for "no distance yet"; sums with squares of coordinates below 10**6 stay exact.
FAR = float(1 << 50)
#: Rows that one step takes together.
STEP_ROWS = 1 << 17
#: Places of a plane at most.
PLANE = 1 << 18


def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; the first one does."""
    out = np.zeros(table.num_rows, bool)
    out[:1] = True
    for name in columns:
        column = table[name].combine_chunks()
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        gone = column.is_null().to_numpy(zero_copy_only=False)
        out[1:] |= other | (gone[1:] != gone[:-1])
    return out


def planes(axes: str, shape: dict[str, int], most: int | None = None) -> list[str]:
    """The axes in groups that are dealt together, the last ones first: as many as span PLANE places at most."""
    out: list[str] = []
    for a in reversed(axes):
        if out and math.prod(shape[b] for b in out[-1] + a) <= (PLANE if most is None else most):
            out[-1] = a + out[-1]
        else:
            out.append(a)
    return out


def along(rows: DataFrame, line: list[str], axis: str, fn: Callable[[pa.Table, np.ndarray], dict[str, np.ndarray]], added: str) -> DataFrame:
    """rows with the columns that fn gives for whole lines. fn gets a table of lines, each sorted by axis, and their first rows.
    axis may name several axes: a line is then a plane (or box), sorted by them.

    added names the columns of fn with their types, as in a schema; columns of that name are replaced.
    """
    names = [part.split()[0] for part in added.split(", ")]
    kept = [c for c in rows.columns if c not in names]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept), added])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done(table: pa.Table):
            got = fn(table, np.flatnonzero(changes(table, line)))
            out = table.select(kept)
            for name in names:
                out = out.append_column(name, pa.array(got[name], from_pandas=True))
            yield from out.combine_chunks().to_batches(max_chunksize=STEP_ROWS)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < STEP_ROWS:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(changes(table, line))[-1])
            if last:  # the last line may go on
                yield from done(table.slice(0, last))
                table = table.slice(last)
            held, size = table.to_batches(), table.num_rows if last else 0
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.repartition(*line).sortWithinPartitions(*line, *axis).mapInArrow(run, schema)


def turned(table: pa.Table, first: np.ndarray, axes: str, axis: str, step: Callable, columns: list[str]) -> dict[str, np.ndarray]:
    """What step gives for the lines along one axis of planes that start at the rows `first`, in the planes' own order."""
    if axis == axes[-1]:
        order = None
    else:
        of = np.zeros(table.num_rows, np.int64)
        of[first] = 1
        order = np.lexsort((table[axis].to_numpy(), *[table[a].to_numpy() for a in axes if a != axis], np.cumsum(of)))
    of = np.zeros(table.num_rows, bool)
    of[first] = True  # planes keep their places in every order
    part = table.select(list(dict.fromkeys([*axes, *columns])))
    if order is not None:
        part = part.take(pa.array(order))
    new = of | changes(part, [a for a in axes if a != axis])
    got = step(part, np.flatnonzero(new))
    if order is None:
        return got
    out = {}
    for name, values in got.items():
        out[name] = np.empty_like(values)
        out[name][order] = values
    return out


def runs(table: pa.Table, first: np.ndarray, axis: str, label: str) -> np.ndarray:
    """First rows of the runs: stretches of one label and consecutive places within a line."""
    place = table[axis].to_numpy().astype(np.int64)
    new = np.zeros(len(place), bool)
    new[first] = True
    new[1:] |= place[1:] != place[:-1] + 1
    new |= changes(table, [label])
    return np.flatnonzero(new)


def lower_envelope(height: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """min over p of (q - p)**2 + height[p] for each q, within each of the stretches [start, stop).

    The best p never moves back as q moves on, so the middle of a range of q bounds where its halves look: every level of
    halving reads each stretch about once, all stretches together.
    """
    out = np.full(len(height), FAR)
    low, high = start.astype(np.int64), stop.astype(np.int64)  # q
    left, right = low.copy(), high - 1  # p, both ends included
    while len(low):
        some = low < high
        low, high, left, right = low[some], high[some], left[some], right[some]
        if not len(low):
            break
        mid = (low + high) // 2
        width = right - left + 1
        at = np.concatenate(([0], np.cumsum(width)[:-1]))
        node = np.repeat(np.arange(len(mid)), width)
        p = np.arange(int(width.sum())) - at[node] + left[node]
        cost = (mid[node] - p).astype(np.float64) ** 2 + height[p]
        best = np.minimum.reduceat(cost, at)
        hit = np.flatnonzero(cost == best[node])
        where = p[hit[np.searchsorted(node[hit], np.arange(len(mid)), "left")]]
        out[mid] = best
        low, high, left, right = np.concatenate((low, mid + 1)), np.concatenate((mid, high)), np.concatenate((left, where)), np.concatenate((where, right))
    return out


def distance_pass(axis: str, size: int, label: str, value: str) -> Callable:
    """One axis of a squared distance to what is not of the run's label: a run ends in zeros, but at the volume's edge."""

    def fn(table: pa.Table, first: np.ndarray) -> dict[str, np.ndarray]:
        place, height = table[axis].to_numpy().astype(np.int64), table[value].to_numpy()
        start = runs(table, first, axis, label)
        stop = np.append(start[1:], len(place))
        before, after = place[start] > 0, place[stop - 1] < size - 1
        # a place more at either end of every run, zero where there is background
        to = np.arange(len(place)) + 1 + 2 * np.repeat(np.arange(len(start)), stop - start)
        wide = np.full(len(place) + 2 * len(start), FAR)
        wide[to] = height
        begin, end = start + 2 * np.arange(len(start)), stop + 2 * np.arange(len(start)) + 2
        wide[begin] = np.where(before, 0.0, FAR)
        wide[end - 1] = np.where(after, 0.0, FAR)
        return {value: np.minimum(lower_envelope(wide, begin, end)[to], FAR)}

    return fn


def gradient_pass(axis: str, size: int, label: str, value: str, name: str) -> Callable:
    """Central difference along the axis, one-sided at the volume's edge; what is not of the run counts as zero."""

    def fn(table: pa.Table, first: np.ndarray) -> dict[str, np.ndarray]:
        place, field = table[axis].to_numpy().astype(np.int64), table[value].to_numpy()
        start = runs(table, first, axis, label)
        before, after = np.concatenate(([0.0], field[:-1])), np.append(field[1:], 0.0)
        before[start] = 0.0
        after[np.append(start[1:], len(field)) - 1] = 0.0
        out = (after - before) / 2
        out = np.where(place == 0, after - field, np.where(place == size - 1, field - before, out))
        return {name: out if size > 1 else np.zeros(len(field))}

    return fn
