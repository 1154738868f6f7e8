"""Periodic runs against a search of all periods, Lyndon lengths against their definition."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lamella.llm import runs

DOCS = "doc_id long, text string, start long, n_runs string, g int"


def all_runs(w, exponent=4, shortest=6):
    found = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            long = j - i + q
            if j > i and long >= max(shortest, exponent * q) and not any(w[i : i + long - p] == w[i + p : i + long] for p in range(1, q)):
                found.add((i, long, q))
            i = max(j, i + 1)
    return found


def longest_lyndon(w):
    return [max(j - i for j in range(i + 1, len(w) + 1) if all(w[i:j] < w[k:j] for k in range(i + 1, j))) for i in range(len(w))]


def periodic(rng, k, n):
    w = []
    while len(w) < n:
        w += [rng.randrange(k) for _ in range(rng.randint(1, 7))] * rng.randint(1, 6)
    return w[:n]


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(600):
        w = periodic(rng, rng.randint(1, 4), rng.randint(0, 22))
        assert runs.lyndon(w) == longest_lyndon(w)


@pytest.mark.parametrize(("exponent", "shortest"), [(4, 6), (2, 2), (2.5, 3), (3, 1)])
def test_runs_of_sequences(exponent, shortest):
    rng = random.Random(2)
    for _ in range(400):
        w = periodic(rng, rng.randint(1, 4), rng.randint(0, 70))
        want = all_runs(w, exponent, shortest)
        assert runs.runs_in(np.array(w, np.int64), exponent, shortest) == want
        cut = runs.stretches(np.zeros(len(w), np.int64), np.array(w, np.int64), exponent, shortest)
        got = {(s + a, long, q) for a, b in zip(*cut, strict=True) for s, long, q in runs.runs_in(np.array(w[a:b], np.int64), exponent, shortest)}
        assert got == want


def test_false_fingerprints_are_caught(monkeypatch):
    monkeypatch.setattr(runs, "_PRIMES", (np.uint64(3), np.uint64(2)))
    rng = random.Random(3)
    for _ in range(200):
        w = periodic(rng, 5, 50)
        assert runs.runs_in(np.array(w, np.int64)) == all_runs(w)


def slow(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if rewrite and n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = sorted(all_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, long, q in found for i in range(s + q, s + long)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{long},{q}\n" for s, long, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)] + ["é", "日本", "a.b"]
    out = [" ".join(words[i] for i in periodic(rng, rng.choice((2, 5, 12)), rng.randint(1, 90))) for _ in range(150)]
    return [*out, None, "", " \n\t ", "x", "x " * 500, "a b\tc\n" * 300, " x " * 7, " ".join(f"w{i % 50}" for i in range(900)), "a b a b a b a b c c c c c c", out[0], out[0]]


def test_collapse_against_all_periods(spark):
    rows = [(i, t, 5, "x", 1) for i, t in enumerate(texts())] + [(3, texts()[3], 5, "x", 1), (None, "a a a a a a a", 5, "x", 1), (-7, "b c " * 9, 5, "x", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted((tuple(r) for r in runs.collapse(runs.rewritten(docs)).collect()), key=key)
    assert got == sorted((slow(r[0], r[1]) for r in rows), key=key)
    plain = sorted((tuple(r) for r in runs.collapse(docs).collect()), key=key)
    assert plain == sorted((slow(r[0], r[1], False) for r in rows), key=key)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_empty_table(spark):
    got = runs.collapse(runs.rewritten(spark.createDataFrame([], DOCS)))
    assert got.columns == runs.NAMES and not got.collect()
    with pytest.raises(ValueError, match="exponent"):
        runs.collapse(got, "runs_sha256", exponent=1)
