"""Periodic runs of words: Lyndon roots by suffix grouping, extended to both sides by common extensions.

A run is a stretch of words whose smallest period is q (words q apart are identical), that is EXPONENT * q words long at
least and that no neighbouring word extends with period q. Every run holds a Lyndon root under one of the two orders of
the words (an order and its reverse), and the longest Lyndon word that starts at each place shows these roots. Phase one
of suffix sorting by groups gives these lengths directly, with no suffix array: suffixes start in groups by their first
word; groups are taken from the highest down, and each one's suffixes point to the nearest place before them that lies
in a lower group, whose suffix moves to a group of its own just above its old one, its context grown by that of the
group (`lyndon`). At the end a suffix's context is the longest Lyndon word at its start. For each root the common
extension of its start and its end, to the right and to the left, bounds the run (`runs_in`).

Only places that can lie in a run are grouped (`stretches`): in a run of exponent e (at least 2) every word stands at
least floor(e) times, every pair of neighbours ceil(e) - 1 times in its stretch. A text is cut where that fails; no run
crosses such a place. With an exponent of 2 nothing is cut by pairs. The rest is exact: words are compared as dictionary
codes; common extensions are found by fingerprints modulo two primes, and every run is then checked word by word
(if a check fails, the stretch is extended word by word).

A task works on slices of about a megabyte of text, or on one longer text; nothing is shuffled.

Results: a row for each input row, in any order; columns other than the id and the text are ignored, whatever their
names. Null, empty and blank texts have no words and no runs. Repeated rows give repeated results. A null id is kept.
Among runs with the same greatest exponent the smallest start, then the smallest period is reported.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import SPACE, raw, slices, word_bounds

#: Least exponent and length of a run.
EXPONENT, LENGTH = 4, 6
#: Primes of the fingerprints and their bases.
_PRIMES = (np.uint64(2147483647), np.uint64(2147483629))
_BASES = (np.uint64(1103515245), np.uint64(1566083941))

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place, by the grouping phase of suffix sorting."""
    n = len(codes)
    order = sorted(range(n), key=codes.__getitem__)  # members of a group stand together; a group is named by its first place
    place, group, size = [0] * n, [0] * n, [0] * n
    first = 0
    for at, i in enumerate(order):
        if codes[i] != codes[order[first]]:
            first = at
        place[i], group[i] = at, first
        size[first] += 1
    length, before = [1] * n, [-1] * n
    end = n
    while end:
        first = group[order[end - 1]]
        members = sorted(order[first:end])
        grown = length[members[0]]
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= first:  # all between before[j] and j lie in higher groups
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, times in pointed.items():
            by_count.setdefault(times, []).append(j)
        for times in sorted(by_count, reverse=True):
            for j in by_count[times]:  # to the end of the group, to leave it
                old = group[j]
                size[old] -= 1
                last, at = old + size[old], place[j]
                other = order[last]
                order[at], order[last] = other, j
                place[other], place[j] = at, last
                length[j] += times * grown
            for j, new in [(j, group[j] + size[group[j]]) for j in by_count[times]]:  # a group may have left as a whole
                group[j] = new
                size[new] += 1
        end = first
    return length


class _Extension:
    """Lengths of common extensions within a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.codes, self.sums, self.ups = codes, [], []
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            up = np.ones(n + 1, np.uint64)
            step, done = base % prime, 1
            while done < n + 1:  # doubling: up[done + k] = up[k] * base ** done
                up[done : 2 * done] = up[: min(done, n + 1 - done)] * step % prime
                step, done = step * step % prime, 2 * done
            values = (codes.astype(np.uint64) + np.uint64(1)) % prime
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * up[:n] % prime, out=sums[1:])
            self.sums.append(sums % prime)
            self.ups.append(up)

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n codes from a and from b (a <= b) have the same fingerprints."""
        ok = np.ones(len(a), bool)
        for prime, sums, up in zip(_PRIMES, self.sums, self.ups, strict=True):
            left = (sums[a + n] + prime - sums[a]) % prime * up[b - a] % prime
            ok &= left == (sums[b + n] + prime - sums[b]) % prime
        return ok

    def reach(self, a: np.ndarray, b: np.ndarray, right: bool) -> np.ndarray:
        """How many codes from a and b on (right), or before them, agree; a < b."""
        low, high = np.zeros(len(a), np.int64), (len(self.codes) - b if right else a).astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            shift = 0 if right else mid
            ok = self.same(a - shift, b - shift, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _plain(codes: np.ndarray, start: int, period: int) -> tuple[int, int]:
    """The stretch of a period around start, found word by word."""
    a, b = start, start + period
    while b < len(codes) and codes[b] == codes[b - period]:
        b += 1
    while a > 0 and codes[a - 1] == codes[a - 1 + period]:
        a -= 1
    return a, b - a


def runs_in(codes: np.ndarray, exponent: float = EXPONENT, shortest: int = LENGTH) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of codes."""
    n, found = len(codes), set()
    if n < max(shortest, math.ceil(exponent)):
        return found
    _, ranks = np.unique(codes, return_inverse=True)
    ranks = ranks.ravel()
    meet = _Extension(ranks)
    roots = []
    for order in (ranks, ranks.max() - ranks):
        root = np.array(lyndon(order.tolist()), np.int64)
        at = np.flatnonzero((root * exponent <= n) & (np.arange(n) + root < n))
        root = root[at]
        right, left = meet.reach(at, at + root, True), meet.reach(at, at + root, False)
        long = root + right + left
        keep = (long >= exponent * root) & (long >= shortest)
        roots.append(np.stack((at - left, long, root, at))[:, keep])
    roots = np.unique(np.concatenate(roots, axis=1), axis=1)
    if not roots.shape[1]:
        return found
    heads = np.flatnonzero(np.concatenate(([True], (np.diff(roots[:3], axis=1) != 0).any(0))))
    for head, stop in zip(heads, [*heads[1:], roots.shape[1]], strict=True):
        start, long, period = roots[:3, head].tolist()
        if _is_run(ranks, start, long, period):
            found.add((start, long, period))
            continue
        for at in roots[3, head:stop].tolist():  # two fingerprints agree by chance
            start, long = _plain(ranks, at, period)
            if long >= exponent * period and long >= shortest:
                found.add((start, long, period))
    return found


def _is_run(codes: np.ndarray, start: int, long: int, period: int) -> bool:
    """Whether the period holds from start on for so many words, and no further to either side."""
    stop = start + long
    further = start and codes[start - 1] == codes[start - 1 + period] or stop < len(codes) and codes[stop] == codes[stop - period]
    return not further and bool((codes[start : stop - period] == codes[start + period : stop]).all())


def stretches(texts: np.ndarray, codes: np.ndarray, exponent: float = EXPONENT, shortest: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the stretches of words in which runs can lie; texts: the text of each word, ascending."""
    least, pairs = math.floor(exponent), math.ceil(exponent) - 1
    at, part = np.arange(len(codes)), texts
    for _ in range(4):  # the counts are taken again within what is left; more rounds would only cut more
        if not len(at):
            break
        of, count = _counts(part, codes[at])
        keep = count[of] >= least
        at, part = at[keep], part[keep]
        if not len(at):
            break
        joined = (np.diff(at) == 1) & (np.diff(part) == 0)
        if pairs > 1 and joined.any():
            left = np.flatnonzero(joined)
            _, word = np.unique(codes[at], return_inverse=True)
            word = word.ravel().astype(np.int64)
            of, count = _counts(part[left], word[left] * (int(word.max()) + 1) + word[left + 1])
            joined[left[count[of] < pairs]] = False
        new = np.concatenate(([0], np.cumsum(~joined)))
        sizes = np.bincount(new)
        keep = sizes[new] >= max(shortest, least)
        same = keep.all() and len(sizes) == len(np.unique(part))
        at, part = at[keep], new[keep]
        if same:
            break
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0)))
    return at[heads], at[np.concatenate((heads[1:], [len(at)])) - 1] + 1


def _counts(part: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each row and rows of each class of equal (part, value)."""
    order = np.lexsort((value, part))
    p, v = part[order], value[order]
    new = np.concatenate(([False], (p[1:] != p[:-1]) | (v[1:] != v[:-1])))
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new)
    return of, np.bincount(of)


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Of runs in order of start and period, the first with the greatest length / period."""
    best = runs[0]
    for run in runs[1:]:
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _rows(column: pa.Array, exponent: float, shortest: int):
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each text."""
    flat, bounds = raw(column)
    starts, ends, upto = word_bounds(flat, bounds)
    texts = np.repeat(np.arange(len(column)), np.diff(upto))
    letters = flat[~SPACE[flat]] if len(flat) else flat
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in zip(*(x.tolist() for x in stretches(texts, codes, exponent, shortest)), strict=True):
        text = int(texts[a])
        found.setdefault(text, []).extend((a - int(upto[text]) + s, long, q) for s, long, q in runs_in(codes[a:b], exponent, shortest))
    spaced = np.full(len(letters) + len(starts), 0x20, np.uint8)  # a space after every word
    spaced[np.arange(len(letters)) + np.repeat(np.arange(len(starts)), ends - starts)] = letters
    blob = spaced.tobytes()
    at = (offsets + np.arange(len(offsets))).tolist()
    none = hashlib.sha256(b"").hexdigest()
    for text in range(len(column)):
        first, last = int(upto[text]), int(upto[text + 1])
        runs = sorted(found.get(text, ()), key=lambda r: (r[0], r[2]))
        if not runs:
            yield 0, None, None, None, None, none, hashlib.sha256(blob[at[first] : max(at[last] - 1, at[first])]).hexdigest()
            continue
        step = np.zeros(last - first + 1, np.int64)
        for s, long, q in runs:
            step[s + q] += 1
            step[s + long] -= 1
        kept = np.flatnonzero(np.cumsum(step[:-1]) == 0) + first
        s, long, q = _best(runs)
        lines = "".join(f"{x[0]},{x[1]},{x[2]}\n" for x in runs)
        cut = np.flatnonzero(np.diff(kept) != 1)
        heads, tails = np.concatenate((kept[:1], kept[cut + 1])).tolist(), np.concatenate((kept[cut], kept[-1:])).tolist()
        rest = b"".join(blob[at[a] : at[b + 1]] for a, b in zip(heads, tails, strict=True))[:-1]
        yield len(runs), s, long, q, 1000 * long // q, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def collapse(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", exponent: float = EXPONENT, shortest: int = LENGTH) -> DataFrame:
    """Runs of each text and its words without the repeats: a row of SCHEMA for each row of docs.

    A word goes if a run contains it after the run's first `period` words. start, length, period and exponent_milli
    (floor of 1000 * length / period) describe the run with the greatest exponent and are null where there is none.
    runs_sha256 hashes the lines `start,length,period`, by start, then period; collapsed_sha256 the words kept, joined
    by one space.
    """
    if exponent < 2:
        raise ValueError("a run has an exponent of 2 at least")

    def run(batches):
        for batch in slices(batches, "text"):
            columns = list(zip(*_rows(batch.column("text"), exponent, shortest), strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=NAMES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of op13's contract, in which a tenth of the documents gets a periodic tail.

    With h = crc32 of the decimal doc_id and g = floor(h / 10): where h % 10 is 0, every word i from a = g % n on becomes
    word a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id leaves its text alone.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.floor(h / 10)).alias("g"), (h % 10).alias("r"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w != '')")
    docs = docs.withColumn("w", F.when((F.col("r") == 0) & F.col("text").isNotNull(), words))
    docs = docs.withColumn("a", F.when(F.size("w") > 0, F.expr("g % size(w)"))).withColumn("p", F.expr("1 + (size(w) - a) div (3 + g % 8)"))
    moved = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, element_at(w, cast(a + (i - a) % p as int) + 1))), ' ')")
    return docs.select("doc_id", F.when(F.col("p").isNotNull(), moved).otherwise(F.col("text")).alias("text"))
