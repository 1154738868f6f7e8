"""Near duplicates by SimHash, found through deletion-variant signatures.

Fingerprints of 64 bits that differ in at most `distance` bits are cut into distance // 2 + 1 segments, so that
one segment differs by one bit at most. Each segment is indexed under every variant with one bit left out; two
segments that are equal or differ in one bit share a variant. An equality of variants gives the candidates, and
the whole fingerprints are compared. Only distinct fingerprints are indexed, so copies cost one row each.

Null text is an empty text; a text without words has fingerprint 0. A null doc_id is kept: it takes part in the
links and gets the smallest non-null doc_id it reaches. Repeated rows give repeated rows. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm import setjoin
from lamella.llm.common import signed, slices
from lamella.plans.graph import connected_components
from lamella.session import cut

#: Members of a variant's bucket that are compared in one task; larger buckets are dealt as pairs of blocks.
BLOCK = 20_000


def fingerprint(text: str | bytes | None, width: int = 4, seed: int = 42) -> int:
    """SimHash of the width-word shingles, repeats included; a bit is 1 if over half the hashes have it."""
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(fps))], names=["doc_id", "fp"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(offset, width) of distance // 2 + 1 segments of 64 bits, as even as can be."""
    n = distance // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return list(zip(cuts, np.diff(cuts).tolist(), strict=False))


def variants(fp: Column, distance: int) -> Column:
    """All one-wildcard variants of every segment, as integers that also tell segment and place."""
    keys = []
    for s, (offset, width) in enumerate(segments(distance)):
        value = F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))
        for i in range(width):
            high = F.shiftleft(F.shiftrightunsigned(value, i + 1), i)
            low = value.bitwiseAND(F.lit((1 << i) - 1))
            keys.append(high.bitwiseOR(low).bitwiseOR(F.lit((s * 64 + i) << 48)))
    return F.array(*keys)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the links a-b with one link for each node: to the first of its component."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints with equal keys at the distance or less, as a forest; keys are sorted."""
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.append(head, len(keys)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Small buckets: every member with the one `lag` places on, all buckets at once.
    small = np.repeat(size <= 64, size)
    left = np.repeat(head + size, size) - np.arange(len(keys))
    at = np.flatnonzero(small)
    lag = 1
    while len(at := at[left[at] > lag]):
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance]
        found.append((near, near + lag))
        lag += 1
    # Large ones: whoever is reached looks only at those not yet reached, so a tight group costs about its size.
    for k in np.flatnonzero(size > 64).tolist():
        rest = np.arange(head[k], head[k] + size[k])
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                hit = np.bitwise_count(fps[x] ^ fps[rest]) <= distance
                if hit.any():
                    got = rest[hit]
                    found.append((np.full(len(got), x), got))
                    front += got.tolist()
                    rest = rest[~hit]
    if not found:
        return fps[:0], fps[:0]
    a, b = (fps[np.concatenate(x)] for x in zip(*found, strict=True))
    return forest(a, b)


def links(fps: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """(src, dst) links between distinct fingerprints (column fp) at the distance or less, as forests of buckets.

    Links within a bucket are a spanning forest: no component is lost, and the rows stay fewer than the bucket's
    members. A bucket above `block` members is cut into blocks, and each pair of blocks is a bucket of its own. At a
    distance of 4 a variant has 20 or 21 bits, so a fingerprint meets about a 2 ** -20th of all others in each of its
    64 variants: that is what the cut into few segments costs, whatever the number of tasks.
    """
    rows = fps.select(F.explode(variants(F.col("fp"), distance)).alias("key"), "fp")
    large = cut(rows.groupBy("key").count().where(F.col("count") > block))
    if not large.isEmpty():
        sized = rows.join(large, "key", "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(0)) / block).cast("int"))
        split = sized.where("n > 0").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("pair"))
        rows = sized.where("n = 0").select("key", "fp").unionByName(split.select(pair.alias("key"), "fp"))

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush(final: bool):
            nonlocal kept, count
            keys, own = (np.concatenate(x) for x in zip(*kept, strict=True))
            end = len(keys) if final else int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            kept, count = [(keys[end:], own[end:])], len(keys) - end
            if end:
                a, b = _linked(keys[:end], own[:end].view(np.uint64), distance)
                yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], names=["src", "dst"])

        for batch in batches:
            kept.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False)))
            count += batch.num_rows
            if count > 500_000:
                yield from flush(False)
        if count:
            yield from flush(True)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs; component_id is the smallest doc_id reachable over links."""
    rows = cut(fingerprints(docs, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    parts = connected_components(links(distinct.select("fp"), distance))
    named = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, width: int = 5, distance: int = 4, star: int = setjoin.STAR, block: int = setjoin.BLOCK) -> DataFrame:
    """(kept_id, kept_0, kept_1): for each class of near copies the doc_id and row hashes (row_hashes) of the row that stays.

    Near copies are texts whose sets of `width`-word shingles have a Jaccard similarity of 0.8 or more; a class is what
    chains of them join. The fingerprints of the sets, found to be near by their variants, give the first links; each
    is verified on the sets themselves, and what they join is one class from then on. At a similarity of 0.8 the
    fingerprints of two sets differ in ten of 64 bits on average, more than variants can find, so the rest is an exact
    join of the sets by prefixes (setjoin), which compares only sets of different classes. No link is lost.

    The row that stays has the least doc_id of its class (null after all others), then the least row hashes.
    """
    docs = setjoin.keyed(docs)
    sets = setjoin.distinct_sets(docs, width)
    named = cut(sets.where("n > 0").groupBy("fp").agg(F.min("id").alias("first")))
    same = sets.where("n > 0").select("id", "fp").join(named, "fp").where("id != first").select(F.col("first").alias("src"), F.col("id").alias("dst"))
    near = links(named.select("fp"), distance).join(named.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src")
    near = near.join(named.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    pairs = same.unionByName(near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))).distinct()
    first = setjoin.verified(pairs, sets, docs, width)
    rest = setjoin.links(sets, docs, width, connected_components(first), star, block)
    parts = connected_components(first.unionByName(rest))
    classes = sets.join(parts, sets["id"] == parts["node"], "left").select("best", F.coalesce("component", "id").alias("class"))
    least = classes.groupBy("class").agg(F.min("best").alias("best"))
    return least.select(F.col("best.doc_id").alias("kept_id"), F.col("best.t0").alias("kept_0"), F.col("best.t1").alias("kept_1"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
