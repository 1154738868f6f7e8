"""Benchmark passages in documents, by the q-gram lemma over diagonal bands and banded alignment.

An item that occurs in a text with at most k edits shares at least m + 1 - q - k * q of its m - q + 1 character
q-grams with the place where it occurs, and all on k + 1 neighbouring diagonals (text place less item place).
Shared q-grams are counted in bands of 2 * k + 1 diagonals, each overlapping the next by half, so that some band
holds them all. Bands that reach the bound are verified by alignment of the whole item within the band.

Texts are compared in lower case (A-Z) with every run of white space as one space, character by character (code
points); k is a share of the item's characters. The benchmark is taken in blocks of bounded size, each sent to all
tasks; the documents are read once a block and nothing else moves. The plan holds every block, so a benchmark has to
fit the driver. Items that are equal after normalisation are searched for once a block.

Null or empty items and texts match nothing; items shorter than q characters after normalisation are looked for as
they are. Repeated documents and repeated items give repeated matches. Extra columns are ignored by matches() and kept by
clean(); null doc_ids are matched like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import SPACE, raw, slices

Q = 8
EDITS = 0.1
#: Odd factor of the q-grams' polynomial.
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of benchmark text that one pass over the documents takes along.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32

MATCHES = "doc_id long, item_id long, start long, end long, edits int"


def normalised(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with single spaces, and the place in flat of each."""
    keep = np.ones(len(flat), bool)
    if len(flat):
        space = SPACE[flat]
        keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return _LOWER[flat[at]], at


def characters(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each UTF-8 character (its bytes side by side), and the places of their first bytes."""
    if not len(low) or low.max() < 128:
        return low, np.arange(len(low))
    at = np.flatnonzero((low & 0xC0) != 0x80)
    size = np.diff(np.append(at, len(low)))
    out = low[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= low[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, at


def grams(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q characters from each place on; alignment verifies what equal hashes suggest."""
    n = max(len(chars) - q + 1, 0)
    out = chars.astype(np.uint64)
    if q == 8 and n:
        factor = _BASE
        for step in (1, 2, 4):
            out = out[:-step] * factor + out[step:]
            factor = np.multiply(factor, factor, dtype=np.uint64) if step < 4 else factor
        return out
    total = np.zeros(n, np.uint64)
    for k in range(q):
        total = total * _BASE + out[k : k + n]
    return total


def _filter_hash(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def find(item: np.ndarray, text: np.ndarray) -> int:
    """The first place of item in text, -1 if there is none."""
    text = text if text.dtype == item.dtype else text.astype(item.dtype)
    wide, data, part = item.itemsize, text.tobytes(), item.tobytes()
    at = data.find(part)
    while at % wide and at >= 0:
        at = data.find(part, at + 1)
    return at // wide if at >= 0 else -1


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of the whole item with a part of text, on diagonals low to high.

    A path starts anywhere on the band's top row; None if it takes more than `most` edits.
    """
    a, b = max(low, 0), max(high + len(item), 0)
    exact = find(item, text[a:b]) if item.itemsize >= text.itemsize else find(item.astype(text.dtype), text[a:b])
    if exact >= 0:
        return 0, a + exact, a + exact + len(item)
    width, far = high - low + 1, np.int32(1 << 20)
    diagonal = np.arange(low, high + 1)
    cost = np.where((diagonal >= 0) & (diagonal <= len(text)), 0, far).astype(np.int32)
    begin = diagonal.copy()
    ramp = np.arange(width, dtype=np.int32)
    for i in range(len(item)):
        col = diagonal + i  # place in text that item[i] meets
        inside = (col >= 0) & (col < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[col[inside]] == item[i]
        step = np.where(inside, cost + np.where(same, 0, 1), far).astype(np.int32)
        skip = np.full(width, far, np.int32)
        skip[:-1] = cost[1:] + 1  # item[i] against nothing: the diagonal falls by one
        skip_begin = np.concatenate((begin[1:], begin[-1:]))
        better = skip < step
        new, from_ = np.where(better, skip, step), np.where(better, skip_begin, begin)
        # Text against nothing: the diagonal rises; a running minimum of cost less place.
        run = new - ramp
        least = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == least, ramp, 0))
        cost, begin = (least + ramp).astype(np.int32), from_[source]
        cost[(col + 1 < 0) | (col + 1 > len(text))] = far
    best = int(cost.argmin())
    if cost[best] > most:
        return None
    return int(cost[best]), max(int(begin[best]), 0), int(diagonal[best] + len(item))


class Index:
    """The q-grams of a block of items, sorted, behind a bitmap of their hashes."""

    def __init__(self, items: list[tuple[int, bytes]], edits: float = EDITS, q: int = Q):
        self.q = q
        owners: dict[bytes, list[int]] = {}
        for item_id, data in items:
            trimmed = normalised(np.frombuffer(data, np.uint8))[0].tobytes().strip()
            if trimmed:
                owners.setdefault(trimmed, []).append(item_id)
        self.ids, self.bytes = list(owners.values()), list(owners)
        self.texts = [characters(np.frombuffer(t, np.uint8))[0] for t in owners]
        # The lemma needs m + 1 - q - k * q > 0; shorter items get fewer edits.
        self.most = [max(0, min(int(len(t) * edits), (len(t) - q) // q)) for t in self.texts]
        parts = [(grams(t, q), np.full(max(len(t) - q + 1, 0), j), np.arange(max(len(t) - q + 1, 0))) for j, t in enumerate(self.texts) if len(t) >= q]
        self.need = np.ones(len(self.texts), np.int64)
        if parts:
            g, j, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            # k edits spoil k * q of any chosen q-grams; of each item those that are rare in the block are enough.
            _, name, count = np.unique(g, return_inverse=True, return_counts=True)
            order = np.lexsort((p, count[name], j))
            lost = np.array(self.most) * q
            n = np.bincount(j, minlength=len(self.texts))
            used = np.minimum(n, lost + np.maximum(8, (n - lost + 1) // 2))
            self.need = np.maximum(1, used - lost)
            rank = np.arange(len(order)) - (np.cumsum(n) - n)[j[order]]
            order = order[rank < used[j[order]]]
            g, j, p = g[order], j[order], p[order]
            order = np.argsort(g, kind="stable")
            self.grams, self.item, self.place = g[order], j[order], p[order]
        else:
            self.grams, self.item, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bitmap = np.zeros(1 << FILTER_BITS, bool)
        self.bitmap[_filter_hash(self.grams)] = True
        self.short = [j for j, t in enumerate(self.texts) if len(t) < q]

    def _hits(self, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, item, place in the item) of every q-gram that the two share."""
        a, b = np.searchsorted(self.grams, g[at], "left"), np.searchsorted(self.grams, g[at], "right")
        n = b - a
        at, a, n = at[n > 0], a[n > 0], n[n > 0]
        rows = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.item[rows], self.place[rows]

    def _bands(self, row: np.ndarray, text_at: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(row, item, band) of the bands that reach the lemma's bound; text_at counts from the row's start."""
        span = np.array(self.most)[item] + 1
        cell = (text_at - place) // span
        # Band c covers the cells c and c + 1: 2k + 2 diagonals, half of them shared with the next band.
        out = np.stack((np.tile(row, 2), np.tile(item, 2), np.concatenate((cell, cell - 1)), np.tile(place, 2)))
        order = np.lexsort(out[::-1])
        out, least = out[:, order], np.tile(self.need[item], 2)[order]
        new = np.ones(out.shape[1], bool)
        new[1:] = (out[:3, 1:] != out[:3, :-1]).any(axis=0)
        once = np.ones(out.shape[1], bool)  # an item's q-gram counts once in a band
        once[1:] = new[1:] | (out[3, 1:] != out[3, :-1])
        head = np.flatnonzero(new)
        counts = np.add.reduceat(once, head, dtype=np.int64)
        return out[:3, head[counts >= least[head]]].T

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item_id, start, end, edits) over a column; start and end in bytes of the text as it is, edits in characters.

        Of overlapping finds of one item the one with the fewest edits stays.
        """
        flat, bounds = raw(column)
        plain, origin = normalised(flat)
        low, at = characters(plain)
        g = grams(low, self.q)
        cuts = np.searchsorted(origin[at], bounds)
        text_at, item, place = self._hits(g, np.flatnonzero(self.bitmap[_filter_hash(g)]))
        row = np.searchsorted(cuts, text_at, "right") - 1
        inside = text_at + self.q <= cuts[row + 1]
        row, text_at, item, place = row[inside], text_at[inside], item[inside], place[inside]
        # Hits with an item in a text at all bound the hits of every band.
        if len(row):
            _, pair, total = np.unique(row * len(self.ids) + item, return_inverse=True, return_counts=True)
            enough = total[pair] >= self.need[item]
            row, text_at, item, place = row[enough], text_at[enough], item[enough], place[enough]
        found: list[tuple[int, int, int, int, int]] = []
        if len(row):
            for r, j, band in self._bands(row, text_at - cuts[row], item, place).tolist():
                span = self.most[j] + 1
                got = aligned(self.texts[j], low[cuts[r] : cuts[r + 1]], band * span, (band + 2) * span - 1, self.most[j])
                if got:
                    found.append((r, j, *got))
        data = plain.tobytes() if self.short else b""
        for j in self.short:
            byte = data.find(self.bytes[j])
            while byte >= 0:
                place = int(np.searchsorted(at, byte))
                r = int(np.searchsorted(cuts, place, "right")) - 1
                if place + len(self.texts[j]) <= cuts[r + 1]:
                    found.append((r, j, 0, place - int(cuts[r]), place - int(cuts[r]) + len(self.texts[j])))
                byte = data.find(self.bytes[j], byte + 1)
        last = np.append(at[1:], len(plain)) - 1  # the last byte of each character
        taken: list[tuple[int, int]] = []
        before = None
        for r, j, edits, start, end in sorted(found):
            if (r, j) != before:
                taken, before = [], (r, j)
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                a, b, base = int(cuts[r]), int(cuts[r + 1]), int(bounds[r])
                for item_id in self.ids[j]:
                    yield r, item_id, int(origin[at[a + start]]) - base, int(origin[last[min(a + end, b) - 1]]) + 1 - base, edits


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items with a text, in blocks of about block_bytes."""
    items, size = [], 0
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        data = row["text"].encode()
        items.append((row["item_id"], data))
        size += len(data)
        if size >= block_bytes:
            yield items
            items, size = [], 0
    if items:
        yield items


def _matches(docs: DataFrame, items: list[tuple[int, bytes]], edits: float) -> DataFrame:
    def run(batches):
        index = Index(items, edits)
        for batch in slices(batches, "text"):
            found = list(index.scan(batch.column("text")))
            if found:
                row, item_id, start, end, n = zip(*found, strict=True)
                columns = [batch.column("doc_id").take(pa.array(row)), pa.array(item_id, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "start", "end", "edits"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each passage found: doc_id, item_id, start and end in bytes of the text, edits."""
    found = [_matches(docs, items, edits) for items in blocks(benchmark, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no item occurs, with all their columns."""
    for items in blocks(benchmark, block_bytes):

        def run(batches, items=items):
            index = Index(items, edits)
            for batch in slices(batches, "text"):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in index.scan(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
