"""Removal of long byte strings that start elsewhere too, by merging shard Burrows-Wheeler transforms.

Which windows of `length` bytes repeat is decided where they can meet. The window's anchor is the least hash among
its substrings of half the length (the leftmost of equals); equal windows have equal anchors at equal places. The
windows of one anchor make one context: the text from the first of them to the end of the last.

1. Batches send every context's two fingerprints, each pair once. A context that occurs twice repeats whole; an
   anchor with a single distinct context needs no more.
2. What is left are the different contexts of one anchor, each from one batch. A batch is a shard: it sends the
   transform of its contexts for each group of anchors, an anchor being one symbol, since every window holds it
   whole. A group merges its shards' transforms by refining their interleave: one stable sort by symbol a step,
   which orders all suffixes by one more symbol. Common prefixes come from the step at which neighbours part; no
   suffix is sorted again. An interval that is still one after as many steps as a window has symbols, and that
   holds two occurrences, is a repeated window.

A batch sends a context once however often it occurs, and a context goes to the merge from one batch only, so a
text that a third of all rows share costs no more than any other. Batches and groups grow in number with the
data. Documents are shuffled once; later passes reuse that exchange.

Null text has no bytes; nothing else depends on doc_id, so null ids and repeated rows count as texts of their own.
Every row gives one row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import _BASE, _INVERSE, _MIX, covered, mixed, powers, raw, slices
from lamella.llm.substring_dedup import BLOB, _blobs, pack_bytes, unpack_bytes

#: Text bytes of a batch, of one NumPy step, and of a group of anchors (text bytes that it stands for).
BATCH_BYTES, STEP, GROUP_BYTES = 6 << 20, 1 << 18, 8 << 20

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: running minima of blocks from both sides."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts(flat: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor's place, anchor's hash, context's hash) of all contexts in texts of flat."""
    gram = length // 2
    width = length - gram + 1
    if len(flat) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = powers(_BASE, len(flat) + 1), powers(_INVERSE, len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_MIX[flat] * up[:-1], out=sums[1:])
    hashes = mixed((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    place_bits = np.uint64(len(flat).bit_length())
    keys = (hashes >> place_bits << place_bits) | np.arange(len(hashes), dtype=np.uint64)
    least = _window_least(keys, width)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    inside = np.arange(len(least)) + length <= ends
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (ends[1:] != ends[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(least)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    place = (least[first] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    whole = (sums[last + length] - sums[first]) * down[first]
    shape = ((place - first) * (length + 1) + (last - first)).astype(np.uint64)
    return first, last, place, hashes[place], mixed(whole + shape * np.uint64(0x9E3779B97F4A7C15))


def suffix_order(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of strings one after another by prefix doubling; ends marks terminators, which differ by place."""
    n = len(symbols)
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * np.int64(max(n, int(rank.max())) + 2) + ahead
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def merge_transforms(shards: list[np.ndarray], steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, interval): the suffixes that share their first `steps` symbols with another one, from the transforms.

    A suffix is a row of the shards' transforms, counted through; symbol 0 ends a string. The interleave starts as
    one shard after the other. Each step sorts it stably by the symbols before its suffixes, which is the interleave
    by one more symbol. Two neighbours are in one interval as long as all their symbols were the same; a suffix that
    is alone in its interval has its place in the merged order and is refined no further, and so is one that has
    come to the end of its string.
    """
    symbols = np.concatenate(shards)
    back = np.empty(len(symbols), np.int64)  # the row of the suffix that is one symbol longer
    base = 0
    for s in shards:
        back[base + np.argsort(s, kind="stable")] = base + np.arange(len(s))
        base += len(s)
    row, interval = np.arange(len(symbols)), np.zeros(len(symbols), np.int32)
    for _ in range(steps):
        before = symbols[row]
        inner = before != 0
        row, before, interval = row[inner], before[inner], interval[inner]
        order = np.argsort(before, kind="stable")
        first, rest, row = before[order], interval[order], back[row[order]]
        new = np.ones(len(row) + 1, bool)
        new[1:-1] = (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])
        shared = ~(new[:-1] & new[1:])
        interval, row = (np.cumsum(new[:-1], dtype=np.int32) - 1)[shared], row[shared]
    return row, interval


class Batch:
    """The contexts of one batch, its distinct (anchor, context) pairs and their groups."""

    def __init__(self, table: pa.Table, length: int, groups: int):
        self.ids, self.length, self.groups = table.column("doc_id"), length, groups
        self.texts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []
        offset = 0
        for part in slices([pa.RecordBatch.from_arrays([pa.concat_arrays(table.column("text").chunks)], names=["text"])], "text", STEP):
            flat, bounds = raw(part.column("text"))
            first, last, place, anchor, context = contexts(flat, bounds, length)
            found.append((first + offset, last + offset, place + offset, anchor, context))
            self.texts.append(flat)
            self.sizes.append(np.diff(bounds))
            offset += len(flat)
        self.flat = np.concatenate(self.texts)
        self.bounds = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes))))
        self.first, self.last, self.place, anchor, context = (np.concatenate(c) for c in zip(*found, strict=True))
        group = (anchor % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((context, anchor, group))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (anchor[a] != anchor[b]) | (context[a] != context[b])
        self.pair = np.empty(len(order), np.int64)
        self.pair[order] = np.cumsum(new) - 1
        self.head = order[new]  # an occurrence of each pair
        self.times = np.bincount(self.pair, minlength=len(self.head))
        self.anchor, self.context, self.group = anchor[self.head], context[self.head], group[self.head]
        self.cuts = np.searchsorted(self.group, np.arange(groups + 1))

    def keys(self):
        for g in np.flatnonzero(np.diff(self.cuts)).tolist():  # the groups that the batch has anything for
            a, b = int(self.cuts[g]), int(self.cuts[g + 1])
            yield g, self.anchor[a:b], self.context[a:b], self.times[a:b] > 1

    def marks(self, replies: pa.Table) -> np.ndarray:
        """The meeting's marks of each pair."""
        by = {g: np.frombuffer(d, np.uint8) for g, d in zip(replies["g"].to_pylist(), replies["data"].to_pylist(), strict=True)}
        return np.concatenate([by[g] for g, *_ in self.keys()]) if len(self.head) else np.zeros(0, np.uint8)

    def shards(self, marks: np.ndarray):
        """(group, transform, weights, anchors, suffixes) of the contexts that this batch sends to the merge.

        suffixes: for each suffix in order the window (a place in flat) it stands for, or -1.
        """
        sent = np.flatnonzero(marks & SENDS)
        if not len(sent):
            return
        gram = self.length // 2
        head = self.head[sent]
        left, right = self.place[head] - self.first[head], self.last[head] + self.length - self.place[head] - gram
        size = left + right + 2
        begin = np.cumsum(size) - size
        n = int(size.sum())
        string = np.repeat(np.arange(len(sent)), size)
        at = np.arange(n) - begin[string]
        source = np.where(at < left[string], self.first[head][string] + at, self.place[head][string] + gram + at - left[string] - 1)
        ends, own = at == size[string] - 1, at == left[string]
        names, name = np.unique(self.anchor[sent], return_inverse=True)
        symbols = self.flat[np.minimum(source, len(self.flat) - 1)].astype(np.int64) + 1
        symbols[own] = 257 + name
        symbols[ends] = 0
        order = suffix_order(symbols, ends)
        previous = np.where(at == 0, 0, symbols[np.maximum(np.arange(n) - 1, 0)])[order]
        window = np.where(at <= (self.last[head] - self.first[head])[string], self.first[head][string] + at, -1)[order]
        weight = np.where(marks[sent] & TWICE, 2, 1).astype(np.uint8)[string][order]
        groups = self.group[sent][string][order]
        # Suffixes by group, in their order; the contexts stand by group already.
        by = np.argsort(groups, kind="stable")
        previous, weight, window, groups = previous[by], weight[by], window[by], groups[by]
        starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
        of_sent = self.group[sent]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)], strict=True):
            g = int(groups[a])
            own_names = np.unique(self.anchor[sent[np.searchsorted(of_sent, g) : np.searchsorted(of_sent, g, "right")]])
            transform = previous[a:b].copy()
            named = transform >= 257
            transform[named] = 257 + np.searchsorted(own_names, names[transform[named] - 257])
            yield g, transform, weight[a:b], own_names, window[a:b]


TWICE, SENDS = np.uint8(1), np.uint8(2)


def _join(pieces: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in pieces)


def _parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def remove_repeats(docs: DataFrame, length: int = 200, batch_bytes: int = BATCH_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the hash of the kept bytes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches, groups = max(1, math.ceil(total / batch_bytes)), max(1, math.ceil(total / group_bytes))
    keyed = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n_batches)))
    steps = length - length // 2 + 1  # symbols of a window: its anchor and the bytes around it

    def send_keys(key, table):
        rows = []
        for g, anchor, context, twice in Batch(table, length, groups).keys():
            pieces = [pack_bytes(np.diff(anchor, prepend=np.uint64(0))), context.tobytes(), np.packbits(twice).tobytes()]
            rows.append((g, key[0].as_py(), len(anchor), _join(pieces)))
        return _blobs(rows)

    def meet_keys(key, table):
        sent = []
        for data, n in zip(table["data"].to_pylist(), table["n"].to_pylist(), strict=True):
            a, c, t = _parts(data)
            sent.append((np.cumsum(unpack_bytes(a, np.uint64), dtype=np.uint64), np.frombuffer(c, np.uint64), np.unpackbits(np.frombuffer(t, np.uint8), count=n)))
        anchor, context, twice = (np.concatenate(x) for x in zip(*sent, strict=True))
        order = np.lexsort((np.repeat(table["batch"].to_numpy(), table["n"].to_numpy()), context, anchor))
        a, b = order[1:], order[:-1]
        new_anchor, new_pair = np.ones(len(order), bool), np.ones(len(order), bool)
        new_anchor[1:] = anchor[a] != anchor[b]
        new_pair[1:] = new_anchor[1:] | (context[a] != context[b])
        pair, name = np.cumsum(new_pair) - 1, np.cumsum(new_anchor) - 1
        often = (np.bincount(pair) > 1) | (np.bincount(pair, twice[order]) > 0)
        several = np.bincount(name[new_pair]) > 1
        open_ = np.bincount(name[new_pair], ~often) > 0  # a context of the anchor is not known to repeat
        marks = np.empty(len(order), np.uint8)
        marks[order] = often[pair] * TWICE + (several & open_)[name] * new_pair * SENDS
        out, at = [], 0
        for batch, n in zip(table["batch"].to_pylist(), table["n"].to_pylist(), strict=True):
            out.append((key[0].as_py(), batch, n, marks[at : at + n].tobytes()))
            at += n
        return _blobs(out)

    def send_shards(key, table, replies):
        if not table.num_rows:
            return _blobs([])
        batch = Batch(table, length, groups)
        rows = []
        for g, transform, weight, names, _ in batch.shards(batch.marks(replies)):
            pieces = [pack_bytes(transform.astype(np.uint32)), weight.tobytes(), names.tobytes()]
            rows.append((g, key[0].as_py(), len(transform), _join(pieces)))
        return _blobs(rows)

    def merge_shards(key, table):
        sent = [_parts(d) for d in table["data"].to_pylist()]
        names = [np.frombuffer(p[2], np.uint64) for p in sent]
        every = np.unique(np.concatenate(names))
        dtype = np.uint16 if len(every) + 257 < 1 << 16 else np.int64
        shards = []
        for p, own in zip(sent, names, strict=True):
            symbols = unpack_bytes(p[0], np.uint32).astype(np.int64)
            named = symbols >= 257
            symbols[named] = 257 + np.searchsorted(every, own[symbols[named] - 257])
            shards.append(symbols.astype(dtype))
        row, interval = merge_transforms(shards, steps)
        weight = np.concatenate([np.frombuffer(p[1], np.uint8) for p in sent])
        hit = np.zeros(len(weight), bool)
        hit[row[(np.bincount(interval, weight[row]) >= 2)[interval]]] = True
        out, at = [], 0
        for batch, n in zip(table["batch"].to_pylist(), table["n"].to_pylist(), strict=True):
            out.append((key[0].as_py(), batch, n, np.packbits(hit[at : at + n]).tobytes()))
            at += n
        return _blobs(out)

    def apply(key, table, replies):
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        batch = Batch(table, length, groups)
        marks = batch.marks(replies.filter(pc.equal(replies["kind"], 0)))
        merged = replies.filter(pc.equal(replies["kind"], 1))
        by = {g: np.unpackbits(np.frombuffer(d, np.uint8), count=n).astype(bool) for g, d, n in zip(merged["g"].to_pylist(), merged["data"].to_pylist(), merged["n"].to_pylist(), strict=True)}
        whole = np.flatnonzero((marks[batch.pair] & TWICE) > 0)
        n = len(batch.flat)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, batch.first[whole], 1)
        np.add.at(step, batch.last[whole] + batch.length, -1)
        gone = np.cumsum(step[:-1]) > 0
        starts = [w[(w >= 0) & by[g]] for g, _, _, _, w in batch.shards(marks)]
        if starts:
            gone |= covered(n, np.concatenate(starts), length)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = batch.bounds[:-1][np.diff(batch.bounds) > 0]
        edge[inner] = gone[inner]
        totals, spans = np.concatenate(([0], np.cumsum(gone))), np.concatenate(([0], np.cumsum(edge)))
        hashes = []
        for a, b in zip(batch.bounds[:-1].tolist(), batch.bounds[1:].tolist(), strict=True):
            own = batch.flat[a:b]
            hashes.append(hashlib.sha256((own if totals[a] == totals[b] else own[~gone[a:b]]).tobytes()).hexdigest())
        columns = [batch.ids, pa.array(np.diff(batch.bounds)), pa.array(np.diff(totals[batch.bounds])), pa.array(np.diff(spans[batch.bounds])), pa.array(hashes)]
        return pa.table(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    met = keyed.groupBy("batch").applyInArrow(send_keys, BLOB).groupBy("g").applyInArrow(meet_keys, BLOB)
    shards = keyed.groupBy("batch").cogroup(met.groupBy("batch")).applyInArrow(send_shards, BLOB)
    merged = shards.groupBy("g").applyInArrow(merge_shards, BLOB)
    replies = met.withColumn("kind", F.lit(0)).unionByName(merged.withColumn("kind", F.lit(1)))
    return keyed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(apply, RESULT)
