"""What near-duplicate search on shingle sets shares: the sets, their verification, and an exact join by prefixes.

Every text is the set of its shingles (hashed to 64 bits). With all sets in one order, two sets A and B at a
similarity of 4/5 or more share a shingle among the first |A| // 5 + 1 and |B| // 5 + 1 of theirs, so that an equality
of prefix shingles gives every pair. Size and place of the shared shingle leave out pairs that cannot be similar; of
the rest the sets are compared. Any order is right; frequent shingles come last, so that few sets share a prefix
shingle by chance. Only distinct sets are indexed, so copies cost one row each.

Null text is an empty text; texts without words have equal (empty) sets. A text of fewer words than a shingle is one
shingle. Rows are told apart by their text and doc_id, not by doc_id alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import mixed, raw, run_hashes, signed, slices, span_hashes, word_bounds
from lamella.plans.graph import connected_components
from lamella.session import cut, settled

#: One text in SAMPLED counts for the order of shingles; the FREQUENT most frequent of them come last.
SAMPLED = 8
FREQUENT = 1 << 18
#: Buckets above STAR members are compared with some of them first, CENTRES in two rounds, then only across the classes
#: found; those above BLOCK are dealt as pairs of blocks. Up to MARKED large buckets are told to the tasks, more are
#: joined.
STAR = 64
CENTRES = (8, 64)
BLOCK = 20_000
MARKED = 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed shingles of each text in ascending order, text after text, and n + 1 bounds."""
    flat, bounds = raw(column)
    flat = _LOWER[flat]
    starts, ends, before = word_bounds(flat, bounds)
    words = span_hashes(flat, starts, ends)
    count = np.diff(before)
    owner = np.repeat(np.arange(len(count)), count)
    full = np.flatnonzero(np.arange(len(words)) + width <= before[1:][owner])
    hashes, owners = [run_hashes(words, width)[full]], [owner[full]]
    for few in range(1, width):
        short = np.flatnonzero(count == few)
        hashes.append(run_hashes(words, few, 1 + few)[before[:-1][short]] if len(short) else words[:0])
        owners.append(short)
    h, own = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))[: len(h)]
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(len(count) + 1), "left")


def prefixes(hashes: np.ndarray, bounds: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first |A| // 5 + 1 shingles of each set A, by count (0 where not among the sorted keys), then hash."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    weight = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        weight = np.where(keys[at] == hashes, counts[at], 0)
    place = np.arange(len(hashes)) - bounds[:-1][owner]
    first = place < size[owner] // 5 + 1
    return hashes[np.lexsort((hashes, weight, owner))][first], np.append(0, np.cumsum(np.bincount(owner[first], minlength=len(size))))


def alike(left: pa.Array, right: pa.Array, width: int = 5) -> np.ndarray:
    """Whether the sets of two texts have a Jaccard similarity of 4/5 or more, pair by pair."""
    (a, at), (b, bt) = shingles(left, width), shingles(right, width)
    n, m = np.diff(at), np.diff(bt)
    h = np.concatenate((a, b))
    own = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    both = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    return 9 * np.bincount(own[1:][both], minlength=len(n)) >= 4 * (n + m)


def _possible(n, m, p, q):
    """Whether sets of n and m shingles that share their p-th and q-th (from 0) can be alike."""
    need = (4 * (n + m) + 8) // 9
    return (np.minimum(n, m) >= need) & (np.minimum(p, q) + 1 + np.minimum(n - p - 1, m - q - 1) >= need)


#: Bits of the parity that every set has beside its own.
SKETCH = 512


def parity(hashes: np.ndarray, bits: int | None = None) -> bytes:
    """The parity of a set in as many bits as it has shingles, up to a power of two; 64 at least."""
    bits = bits or (max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64)
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def parted(x: bytes, y: bytes) -> int:
    """A lower bound of the shingles that only one of two sets has: the bits in which their parities differ."""
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    for have in (len(x), len(y)):
        have *= 8
        while have > bits:
            have //= 2
            if len(x) > len(y):
                a = (a >> have) ^ (a & ((1 << have) - 1))
            else:
                b = (b >> have) ^ (b & ((1 << have) - 1))
    return (a ^ b).bit_count()


def _frequent(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that more than one sampled text has, and their counts: FREQUENT at most, for the order only."""

    def run(batches):
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(signed(shingles(batch.column("text"), width)[0]))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    keys, counts = top.column("h").to_numpy().view(np.uint64), top.column("count").to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def set_fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if over half of its shingles' hashes have it."""
    half = np.diff(bounds)
    out = np.zeros(len(half), np.uint64)
    for bit in range(64):
        sums = np.append(0, np.cumsum((hashes >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))
        out |= (2 * (sums[bounds[1:]] - sums[bounds[:-1]]) > half).astype(np.uint64) << np.uint64(bit)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t0, t1): the rows with their hashes."""
    t0, t1 = row_hashes(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), t0.alias("t0"), t1.alias("t1"))


def distinct_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, w0, w1, n, best, fp, bits, sketch, prefix) for each distinct set of keyed rows: hashes and size of the set,
    the least row that has it, its SimHash, parities and prefix.
    """
    keys, counts = _frequent(docs, width)

    def run(batches):
        for batch in slices(batches, "text"):
            hashes, bounds = shingles(batch.column("text"), width)
            own = []
            for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                sums = np.append(np.uint64(0), np.cumsum(mixed(hashes ^ np.uint64(salt)), dtype=np.uint64))
                own.append(pa.array(signed(sums[bounds[1:]] - sums[bounds[:-1]])))
            first, ends = prefixes(hashes, bounds, keys, counts)
            prefix = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(first)))
            cut_ = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            bits, sketch = pa.array([parity(h) for h in cut_], pa.binary()), pa.array([parity(h, SKETCH) for h in cut_], pa.binary())
            size, fp = pa.array(np.diff(bounds).astype(np.int32)), pa.array(signed(set_fingerprints(hashes, bounds)))
            columns = [*(batch.column(c) for c in ("doc_id", "t0", "t1")), *own, size, fp, bits, sketch, prefix]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t0", "t1", "w0", "w1", "n", "fp", "bits", "sketch", "prefix"])

    rows = docs.mapInArrow(run, "doc_id long, t0 long, t1 long, w0 long, w1 long, n int, fp long, bits binary, sketch binary, prefix array<long>")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("best")
    sets = settled(rows).groupBy("w0", "w1", "n").agg(best, *(F.first(c).alias(c) for c in ("fp", "bits", "sketch", "prefix")))
    return settled(sets.withColumn("id", F.monotonically_increasing_id()))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """rows with each bucket above `block` members cut into blocks, and a bucket for each pair of blocks."""
    large = cut(rows.groupBy("key").count().where(F.col("count") > block))
    if not large.isEmpty():
        sized = rows.join(large, "key", "left").withColumn("k", F.ceil(F.coalesce("count", F.lit(0)) / block).cast("int"))
        split = sized.where("k > 0").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"), F.lit("pair"))
        rows = sized.where("k = 0").select(*rows.columns).unionByName(split.withColumn("key", pair).select(*rows.columns))
    return rows


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """(src, dst) of ids that share a key, differ in part and can be alike. rows: key, id, n, pos, part, and perhaps
    sketch: then pairs whose parities differ in too many bits are left out here, before anything is written of them.
    """
    names = ["key", "id", "n", "pos", "part", *(["sketch"] if "sketch" in rows.columns else [])]

    def run(batches):
        kept: list[list[np.ndarray]] = []
        count = 0

        def flush(final: bool):
            nonlocal kept, count
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            keys = columns[0]
            end = len(keys) if final else int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
            kept, count = [[c[end:] for c in columns]], len(keys) - end
            if not end:
                return
            keys, ids, n, pos, part, *sketch = (c[:end] for c in columns)
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            size = np.diff(np.append(head, end))
            left = np.repeat(head + size, size) - np.arange(end)
            at, lag, found, waiting = np.arange(end), 1, [], 0
            while len(at := at[left[at] > lag]) or found:
                hit = at[(part[at] != part[at + lag]) & _possible(n[at], n[at + lag], pos[at], pos[at + lag])]
                if sketch:
                    apart = np.bitwise_count(sketch[0][hit] ^ sketch[0][hit + lag]).sum(axis=1, dtype=np.int64)
                    hit = hit[9 * apart <= n[hit].astype(np.int64) + n[hit + lag]]
                found.append((ids[hit], ids[hit + lag]))
                waiting += len(hit)
                lag += 1
                if waiting > 200_000 or not len(at):
                    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["src", "dst"])
                    found, waiting = [], 0

        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names[:5]]
            kept.append(own + [raw(batch.column(c))[0].view(np.uint64).reshape(-1, SKETCH // 64) for c in names[5:]])
            count += batch.num_rows
            if count > 500_000:
                yield from flush(False)
        if count:
            yield from flush(True)

    rows = rows.select(*names)
    # Dealt by a hash of the key: a deal by the key itself is left out after a join on it, whose readers may split keys.
    return rows.repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(run, "src long, dst long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets are alike: parities leave out what cannot be, texts decide the rest."""

    def near(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            apart = [parted(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["src", "dst"]).filter(pa.array(9 * np.array(apart, np.int64) <= n + m))

    def run(batches):
        for batch in slices(batches, "a"):
            hit = pa.array(alike(batch.column("a"), batch.column("b"), width))
            yield batch.select(["src", "dst"]).filter(hit)

    known = cut(pairs).join(sets.select(F.col("id").alias("src"), "n", F.col("bits").alias("x")), "src")
    known = known.join(sets.select(F.col("id").alias("dst"), F.col("n").alias("m"), F.col("bits").alias("y")), "dst")
    pairs = settled(known.select("src", "dst", "n", "m", "x", "y").mapInArrow(near, "src long, dst long"))
    ends = pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id"))).distinct()
    one = sets.join(ends, "id", "left_semi").select("id", "best.t0", "best.t1")
    texts = settled(docs.join(one, ["t0", "t1"]).groupBy("id").agg(F.first("text").alias("text")))
    both = pairs.join(texts.select(F.col("id").alias("src"), F.col("text").alias("a")), "src")
    both = both.join(texts.select(F.col("id").alias("dst"), F.col("text").alias("b")), "dst")
    return settled(both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long"))


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one class of parts."""
    for end in ("src", "dst"):
        pairs = pairs.join(parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")), end, "left")
    return pairs.where(F.coalesce("src_part", "src") != F.coalesce("dst_part", "dst")).select("src", "dst")


def _centred(rows: DataFrame, most: int) -> DataFrame:
    """(src, dst): each row with `most` rows of its bucket, chosen by the hash of their ids, of other classes."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("id"))
    centres = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    centres = centres.select(F.col("key").alias("c_key"), F.col("id").alias("c_id"), F.col("n").alias("c_n"), F.col("pos").alias("c_pos"), F.col("part").alias("c_part"))
    need = F.expr("(4 * (n + c_n) + 8) div 9")
    can = (F.least("n", "c_n") >= need) & (F.least("pos", "c_pos") + 1 + F.least(F.expr("n - pos - 1"), F.expr("c_n - c_pos - 1")) >= need)
    met = rows.join(centres, (F.col("key") == F.col("c_key")) & (F.col("part") != F.col("c_part")) & can)
    return met.select(F.least("id", "c_id").alias("src"), F.greatest("id", "c_id").alias("dst")).distinct()


def _classed(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """rows with the class of their id as part."""
    parts = connected_components(linked).withColumnRenamed("node", "id")
    return rows.drop("part").join(parts, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")


def links(sets: DataFrame, docs: DataFrame, width: int, parts: DataFrame | None = None, star: int = STAR, block: int = BLOCK) -> DataFrame:
    """(src, dst) of ids with alike sets; each pair of alike sets is one of them or joined by a chain of them and of parts.

    parts: (node, component) of sets that are known to be of one class, if any. The members of a large bucket that are
    alike are brought into one class first, by comparing each with few others of the largest bucket that it is in; a
    tight group gives hardly any pairs after that. All pairs that are left between classes are compared then.
    """
    entries = sets.where("n > 0").select("id", "n", F.posexplode("prefix").alias("pos", "key")).withColumn("part", F.col("id"))
    across = (lambda pairs: _across(pairs, parts)) if parts is not None else (lambda pairs: pairs)
    large = settled(entries.groupBy("key").count().where(F.col("count") > star))
    if large.isEmpty():
        return verified(across(_bucket_pairs(entries)), sets, docs, width)
    large = F.broadcast(large) if large.count() <= MARKED else large
    small = entries.join(large, "key", "left_anti")
    rows = settled(entries.join(large, "key"))
    home = rows.groupBy("id").agg(F.max(F.struct("count", "key", "n", "pos")).alias("h")).select("id", "h.key", "h.n", "h.pos", F.col("id").alias("part"))
    near = verified(across(_bucket_pairs(small).unionByName(_centred(home, CENTRES[0])).distinct()), sets, docs, width)
    known = near if parts is None else near.unionByName(parts.select(F.col("component").alias("src"), F.col("node").alias("dst")).where("src != dst"))
    home = settled(_classed(home, known))
    merged = home.groupBy("key").agg(F.count_distinct("part").alias("parts"), F.count("id").alias("members")).where("parts < members and parts > 1").select("key")
    second = verified(_centred(home.join(merged, "key", "left_semi"), CENTRES[1]), sets, docs, width)
    rows = _classed(rows.drop("count"), known.unionByName(second))
    open_ = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("key")
    rest = settled(rows.join(open_, "key").join(sets.select("id", "sketch"), "id"))
    return near.unionByName(second).unionByName(verified(_bucket_pairs(_dealt(rest, block)), sets, docs, width))


def row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes that tell rows apart by doc_id and text."""
    own = [docs["doc_id"].isNull(), docs["doc_id"].cast("long"), docs["text"].isNull(), docs["text"].cast("string")]
    return F.xxhash64(F.lit(0), *own), F.xxhash64(F.lit(1), *own)
