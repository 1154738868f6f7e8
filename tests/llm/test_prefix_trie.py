"""The trie of rebuilt conversations against one built from whole texts."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lamella.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth long, cls string, n int, up int"

def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, 2) for r in rows], TURNS)


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(convs.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        leaf = lambda m: not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in members)
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(inside), len(node), parent, len(inside), sum(len(m) == len(node) + 1 for m in below), sum(map(leaf, below)), sum((len(members[m]) - 1) * words(m) for m in below), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows, parts=3, **options):
    conv = F.col("conv_id")
    got = prefix_trie.trie(frame(spark, rows).repartition(parts), conv - conv % 20, F.crc32(conv.cast("string")) % 4, **options)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2])


def conversations(seed, n=70):
    rng = random.Random(seed)
    says = ["a", "b c", "", None, "x y z", " \t", "é ü"]
    rows = []
    for c in rng.sample(range(-5, 2 * n), n):
        for turn in range(rng.randint(1, 5)):
            rows.append((c, turn, rng.choice(["user", "bot", None]) if turn > 2 else "user", rng.choice(says)))
    rows += [(200, t, "user", "a") for t in range(3)] + [(c, t, "user", "a") for c in (201, 203, 205, 207, 209, 211) for t in range(4)]
    rows += [(None, 0, "user", "lost"), (rows[0][0], None, "user", "first"), (300, 5, "u", "t"), (300, 5, "u", "t"), (300, -5, "u", "t")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_whole_texts(spark, seed):
    rows = conversations(seed)
    assert found(spark, rows) == brute(rows)


def test_one_long_conversation_over_many_partitions(spark):
    rows = [(40, t, "user", f"w{t % 3} x") for t in range(150)] + [(41 + c, t, "user", f"w{t % 3} x") for c in range(12) for t in range(10 * c + 1)]
    assert found(spark, rows, parts=5) == brute(rows)


def test_shared_hashes_are_caught(spark):
    rows = conversations(3, 25)
    weak = lambda attempt: F.xxhash64(F.lit(attempt), "role", "text") % (3 if attempt == 0 else 2**62)
    assert found(spark, rows, hashed=weak) == brute(rows)
    bases = ((0, 0), *prefix_trie.BASES[1:])  # only the first turn counts
    assert found(spark, rows, bases=bases) == brute(rows)
    with pytest.raises(RuntimeError, match="share"):
        found(spark, rows, hashed=lambda attempt: F.lit(attempt).cast("long"))


def test_packed_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACK", 20)
    ends = spark.createDataFrame([(1, 2, 3, c) for c in range(-50, 400)] + [(0, 0, 0, 5)], "depth long, k0 long, k1 long, conv_id long").repartition(4)
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie._end_hashes(ends).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(-50, 400))).encode()).hexdigest(), 0: hashlib.sha256(b"5").hexdigest()}


def test_bare_and_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "t")]) == []
    rows = [(c, 0, "u", "t") for c in (41, 45, 52)]  # no base: a head takes their only turn
    assert found(spark, rows) == brute(rows)
