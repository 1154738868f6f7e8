"""Removal of word windows that an earlier document has, by prefix-partitioned suffix trees.

The strings are documents as sequences of words, the suffixes start at words, and the trees are cut off at the
window's depth: a node that deep is a word sequence that occurs more than once, and its leaves are the occurrences.
Consecutive windows at such nodes join into the repeats.

1. Vertical partitioning. A census counts words (in hashed classes of fixed number). A suffix's prefix has as many
   words as it takes until the product of their shares is below a quarter of a group's share: one or two rare words,
   several frequent ones, at most the window. No two prefixes start alike, so every suffix has exactly one; prefixes
   are dealt to the groups by hash. The rule needs the census only, however many groups there are.
2. Every batch of documents sends each group the keys of its suffixes, each once, sorted and delta-coded. A key
   that no other batch has is a leaf of its own: its suffix goes no further.
3. The rest go to their group, sorted and front-coded: the length of the prefix shared with the suffix before, then
   the words that follow, with the smallest document they start in. Beyond the first HEAD words a path is compact:
   the nodes there that are less deep than the window give no repeat of its length, so the edge over them is one
   symbol, a 64-bit fingerprint of its words. The group merges the suffixes into the suffix array of its subtree with
   the lengths of common prefixes, which is the tree; neighbours that share the window's depth stand below one deep
   internal node. Each node yields its smallest document, and the batches learn which of their leaves stand below a
   node with a smaller one.

A word is 40 bits of its hash in the trees, in their order. For different windows to be taken for one, the keys of 34
bits, the words of the head and the fingerprint of the rest have to agree at once. A batch
sends a word sequence once however often it occurs, so a passage that a third of all documents share costs a row
per batch. A batch writes rows for the groups that it has suffixes of, so their number is bounded by the suffixes,
not by batches times groups. Documents are shuffled once; the later passes reuse that exchange.

Null text has no words. A null doc_id counts as larger than every other and null ids do not repeat each other;
rows with the same doc_id do not repeat each other. Every input row gives one row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import _BASE, _INVERSE, covered, mixed, powers, raw, run_hashes, slices, span_hashes, word_bounds

#: Text bytes of a batch, suffixes of a subtree, and hashed classes of words in the census.
BATCH_BYTES = 6 << 20
SUBTREE = 2_000_000
CLASSES = 1 << 16
#: Bits of the key of the first exchange, besides the group.
KEY_BITS = 34
#: Words of a suffix that are symbols of their own, and bits of a word's hash that the symbol keeps.
HEAD, WORD_BITS = 3, 40
LAST = np.int64(2**63 - 1)

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after another, and n + 1 bounds in words."""
    hashes, bounds, total = [], [np.zeros(1, np.int64)], 0
    for part in slices([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
        flat, cuts = raw(part.column("text"))
        starts, ends, before = word_bounds(flat, cuts)
        hashes.append(span_hashes(flat, starts, ends))
        bounds.append(before[1:] + total)
        total += len(starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(bounds)


def window_starts(bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a whole window starts, and their documents' places."""
    lengths = np.maximum(np.diff(bounds) - window + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(len(doc)) - first[doc] + bounds[:-1][doc], doc


def pack_bytes(x: np.ndarray) -> bytes:
    """Bytes by significance, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def unpack_bytes(data: bytes, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(dtype).ravel()


def census(docs: DataFrame, window: int) -> tuple[np.ndarray, int, int]:
    """Word counts by class over all documents, the count of windows, and the text bytes."""

    def run(batches):
        counts = np.zeros(CLASSES, np.int64)
        windows = size = 0
        for batch in slices(batches, "text"):
            words, bounds = word_hashes(batch.column("text"))
            counts += np.bincount((words % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES)
            windows += int(np.maximum(np.diff(bounds) - window + 1, 0).sum())
            size += len(raw(batch.column("text"))[0])
        at = np.append(np.flatnonzero(counts), [CLASSES, CLASSES + 1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.append(counts, [windows, size])[at])], names=["class", "count"])

    out = np.zeros(CLASSES + 2, np.int64)
    for row in docs.select("text").mapInArrow(run, "class int, count long").groupBy("class").agg(F.sum("count").alias("count")).collect():
        out[row["class"]] = row["count"]  # at most the fixed number of classes
    return out[:CLASSES], int(out[CLASSES]), int(out[CLASSES + 1])


class Partitions:
    """The vertical partitioning: a suffix's variable-length prefix, and the group of the prefix."""

    def __init__(self, counts: np.ndarray, groups: int, window: int):
        share = np.maximum(counts, 1) / max(int(counts.sum()), 1)
        self.bits = np.round(-np.log2(np.minimum(share, 0.999)) * 1024).astype(np.int64) + 1
        self.need, self.groups, self.window = int(math.ceil(math.log2(4 * groups) * 1024)), groups, window

    def lengths(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Words of the prefix of each suffix, from one to the window."""
        sums = np.concatenate(([0], np.cumsum(self.bits[(words % np.uint64(CLASSES)).astype(np.int64)])))
        return np.clip(np.searchsorted(sums, sums[starts] + self.need, "left") - starts, 1, self.window)

    def of(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The group of each suffix."""
        if not len(starts):
            return np.zeros(0, np.int64)
        n = self.lengths(words, starts)
        up, down = powers(_BASE, len(words) + 1), powers(_INVERSE, len(words) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)))
        return (mixed((sums[starts + n] - sums[starts]) * down[starts] + n.astype(np.uint64)) % np.uint64(self.groups)).astype(np.int64)


def sort_suffixes(heads: np.ndarray, tails: np.ndarray, window: int, size: int, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes given as rows of symbols below `size` and the fingerprint of what follows up to the window, and
    the symbols that each in that order shares with the one before (all of the window with the fingerprint). With
    `first`, that comes before all in the order, and suffixes that differ in it share -1.
    """
    n, head = heads.shape
    bits = max(int(size - 1).bit_length(), 1)
    per = 63 // bits
    keys = []
    for a in range(0, head, per):
        packed = np.zeros(n, np.int64)
        for c in range(a, min(a + per, head)):
            packed = (packed << bits) | heads[:, c]
        keys.append(packed)
    order = np.lexsort((tails, *keys[::-1], *(() if first is None else (first,))))
    heads, tails = heads[order], tails[order]
    common = np.zeros(n, np.int8)
    alive = np.ones(max(n - 1, 0), bool)
    for c in range(head):
        alive &= heads[1:, c] == heads[:-1, c]
        common[1:] += alive
    common[1:][alive & (tails[1:] == tails[:-1])] = window
    if n:
        common[0] = -1
    if first is not None:
        common[1:][first[order][1:] != first[order][:-1]] = -1
    return order, common


def front_coded(heads: np.ndarray, tails: np.ndarray, common: np.ndarray, names: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted suffixes of one group (symbols are places in names), each with a document."""
    own, at = np.unique(heads, return_inverse=True)
    rest = at.reshape(heads.shape)[np.arange(heads.shape[1])[None, :] >= common[:, None]]
    ids, doc = np.unique(docs, return_inverse=True)
    pieces = [pack_bytes(np.diff(names[own], prepend=np.uint64(0))), pack_bytes(common), pack_bytes(rest.astype(np.uint32)), tails.tobytes(), pack_bytes(ids), pack_bytes(doc.astype(np.uint32))]
    return b"".join(len(p).to_bytes(8, "little") + p for p in pieces)


def front_decoded(data: bytes, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, rows of places in names, fingerprints, documents) as they were coded."""
    pieces, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        pieces.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    names = np.cumsum(unpack_bytes(pieces[0], np.uint64), dtype=np.uint64)
    common = unpack_bytes(pieces[1], np.int8)
    told = np.arange(head)[None, :] >= common[:, None]
    rows = np.zeros(told.shape, np.int64)
    rows[told] = unpack_bytes(pieces[2], np.uint32)
    source = np.where(told, np.arange(len(common))[:, None], 0)
    rows = np.take_along_axis(rows, np.maximum.accumulate(source, axis=0), axis=0)
    return names, rows, np.frombuffer(pieces[3], np.uint64), unpack_bytes(pieces[4], np.int64)[unpack_bytes(pieces[5], np.uint32)]


def deep_nodes(common: np.ndarray, window: int) -> np.ndarray:
    """The deep internal node above each leaf of a subtree, numbered in order: leaves that share `window` symbols."""
    return np.cumsum(common < window) - 1


class Batch:
    """The suffixes of one batch of documents, with their groups and keys."""

    def __init__(self, table: pa.Table, window: int, parts: Partitions):
        self.table, self.window = table, window
        self.text = pa.concat_arrays(table.column("text").chunks)
        self.ids = np.array([LAST if x is None else x for x in self.table.column("doc_id").to_pylist()], np.int64)
        self.words, self.bounds = word_hashes(self.text)
        self.starts, place = window_starts(self.bounds, window)
        self.doc = self.ids[place]
        first = run_hashes(self.words, window, window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)
        self.group = parts.of(self.words, self.starts)
        key = (self.group.astype(np.uint64) << np.uint64(KEY_BITS)) | (first >> np.uint64(64 - KEY_BITS))
        self.keys, self.of_key, self.times = np.unique(key, return_inverse=True, return_counts=True)

    def key_parts(self):
        """(group, its keys) in the order of self.keys, for the groups that the batch has."""
        for g, a, b in runs((self.keys >> np.uint64(KEY_BITS)).astype(np.int64)):
            yield g, self.keys[a:b] & np.uint64((1 << KEY_BITS) - 1)

    def sort(self, which: np.ndarray) -> None:
        """Sort the suffixes at these places by group and words; distinct ones are numbered in node (-1: not asked for)."""
        at = np.flatnonzero(which)
        head = min(HEAD, self.window - 1)
        places = self.starts[at][:, None] + np.arange(head)[None, :]
        inside = np.zeros(len(self.words), bool)
        inside[places] = True
        self.names, name = np.unique(self.words[inside] >> np.uint64(64 - WORD_BITS), return_inverse=True)
        symbols = np.zeros(len(self.words), np.int32)
        symbols[inside] = name
        rows = symbols[places]
        tails = run_hashes(self.words, self.window - head, 21)[self.starts[at] + head] if len(at) else np.zeros(0, np.uint64)
        order, common = sort_suffixes(rows, tails, self.window, max(len(self.names), 1), self.group[at])
        node = deep_nodes(common, self.window)
        self.node = np.full(len(self.starts), -1, np.int64)
        self.node[at[order]] = node
        own = np.flatnonzero(common < self.window)
        self.rows, self.tails, self.common = rows[order[own]], tails[order[own]], common[own]
        self.node_group = self.group[at[order[own]]]
        self.least = np.minimum.reduceat(self.doc[at[order]], own) if len(own) else np.zeros(0, np.int64)


def runs(sorted_values: np.ndarray):
    """(value, start, end) of the runs of equal values."""
    if not len(sorted_values):
        return
    cuts = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    yield from zip(sorted_values[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(sorted_values)).tolist(), strict=True)


def bits(rows: pa.Table) -> dict[int, np.ndarray]:
    return {g: np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for g, b, n in zip(rows["g"].to_pylist(), rows["data"].to_pylist(), rows["n"].to_pylist(), strict=True)}


BLOB = "g int, batch long, n long, data binary"


def _blobs(rows: list[tuple]) -> pa.Table:
    g, batch, n, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(g, pa.int32()), pa.array(batch, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["g", "batch", "n", "data"])


def remove_repeats(docs: DataFrame, window: int = 13, batch_bytes: int = BATCH_BYTES, subtree: int = SUBTREE) -> DataFrame:
    """For each row: doc_id, n_words, n_removed and the hash of the kept words joined by a space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts, windows, size = census(docs, window)
    n_batches = max(1, math.ceil(size / batch_bytes))
    parts = Partitions(counts, max(1, math.ceil(windows / subtree)), window)
    keyed = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n_batches)))

    def send_keys(key, table):
        rows = []
        for g, keys in Batch(table, window, parts).key_parts():
            rows.append((g, key[0].as_py(), len(keys), pack_bytes(np.diff(keys, prepend=np.uint64(0)))))
        return _blobs(rows)

    def meet_keys(key, table):
        """Which keys of each batch another batch has."""
        sent = [np.cumsum(unpack_bytes(b, np.uint64), dtype=np.uint64) for b in table["data"].to_pylist()]
        values = np.concatenate(sent)
        values.sort()
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        out = []
        for batch, keys in zip(table["batch"].to_pylist(), sent, strict=True):
            at = np.minimum(np.searchsorted(twice, keys), max(len(twice) - 1, 0))
            hit = twice[at] == keys if len(twice) else np.zeros(len(keys), bool)
            out.append((key[0].as_py(), batch, len(keys), np.packbits(hit).tobytes()))
        return _blobs(out)

    def shared(batch: Batch, replies: pa.Table) -> np.ndarray:
        by = bits(replies)
        return np.concatenate([by[g] for g, _ in batch.key_parts()]) if len(batch.keys) else np.zeros(0, bool)

    def send_suffixes(key, table, replies):
        if not table.num_rows:
            return _blobs([])
        batch = Batch(table, window, parts)
        batch.sort(shared(batch, replies)[batch.of_key])
        rows = []
        for g, a, b in runs(batch.node_group):
            rows.append((g, key[0].as_py(), b - a, front_coded(batch.rows[a:b], batch.tails[a:b], batch.common[a:b], batch.names, batch.least[a:b])))
        return _blobs(rows)

    def subtree_leaves(key, table):
        """The subtree of a group; which leaves of each batch stand below a deep node with a smaller document."""
        names, rows, tails, docs_ = zip(*(front_decoded(data, min(HEAD, window - 1)) for data in table["data"].to_pylist()), strict=True)
        every = np.unique(np.concatenate(names))
        rows = np.concatenate([np.searchsorted(every, own).astype(np.int32)[r] for own, r in zip(names, rows, strict=True)])
        doc = np.concatenate(docs_)
        order, common = sort_suffixes(rows, np.concatenate(tails), window, len(every))
        node = deep_nodes(common, window)
        least = np.minimum.reduceat(doc[order], np.flatnonzero(common < window))[node]
        smaller = np.empty(len(order), bool)
        smaller[order] = least < doc[order]
        out, at = [], 0
        for batch, n in zip(table["batch"].to_pylist(), table["n"].to_pylist(), strict=True):
            out.append((key[0].as_py(), batch, n, np.packbits(smaller[at : at + n]).tobytes()))
            at += n
        return _blobs(out)

    def apply(key, table, replies):
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        batch = Batch(table, window, parts)
        sent = shared(batch, replies.filter(pc.equal(replies["kind"], 0)))[batch.of_key]
        gone = np.zeros(len(batch.starts), bool)
        batch.sort(sent)
        by = bits(replies.filter(pc.equal(replies["kind"], 1)))
        smaller = np.concatenate([by[g] for g, _, _ in runs(batch.node_group)]) if len(batch.node_group) else np.zeros(0, bool)
        gone[sent] = smaller[batch.node[sent]] | (batch.doc[sent] > batch.least[batch.node[sent]])
        # Windows that no other batch has, but this one more than once.
        own = ~sent & (batch.times > 1)[batch.of_key]
        batch.sort(own)
        gone[own] = batch.doc[own] > batch.least[batch.node[own]]
        n = int(batch.bounds[-1])
        removed = covered(n, batch.starts[gone], window)
        totals = np.concatenate(([0], np.cumsum(removed)))
        hashes = []
        for k, text in enumerate(batch.text.to_pylist()):
            a, b = int(batch.bounds[k]), int(batch.bounds[k + 1])
            words = (text or "").encode().split()
            if totals[b] > totals[a]:
                words = [w for w, r in zip(words, removed[a:b].tolist(), strict=True) if not r]
            hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table([batch.table["doc_id"], pa.array(np.diff(batch.bounds)), pa.array(np.diff(totals[batch.bounds])), pa.array(hashes)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    met = keyed.groupBy("batch").applyInArrow(send_keys, BLOB).groupBy("g").applyInArrow(meet_keys, BLOB)
    suffixes = keyed.groupBy("batch").cogroup(met.groupBy("batch")).applyInArrow(send_suffixes, BLOB)
    trees = suffixes.groupBy("g").applyInArrow(subtree_leaves, BLOB)
    replies = met.withColumn("kind", F.lit(0)).unionByName(trees.withColumn("kind", F.lit(1)))
    return keyed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(apply, RESULT)
