"""Near duplicates by exact set similarity against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import setjoin, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, min(len(words), 1))))


def survivors(rows):
    """Brute force: the (doc_id, text) that stay of each class."""
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if 5 * len(sets[i] & sets[j]) >= 4 * union and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    out = {}
    for (doc_id, _), k in zip(rows, label, strict=True):
        out[k] = min(out.get(k, (True, 0)), (doc_id is None, doc_id or 0))
    return sorted(out.values())


def kept(spark, rows):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def varied(seed):
    """Families of texts whose similarity to their first one goes from 0.4 to 1, and a line that all share."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(4, 150))]
        rows += [(len(rows) + k, "a line that all of these texts share " * (k % 3 == 0) + edited(rng, base, min(len(base), int(rng.integers(0, 5))))) for k in range(10)]
    return rows


def test_below_the_threshold_stays_and_none_is_missed(spark):
    rows = varied(1)
    assert kept(spark, rows) == survivors(rows)


@pytest.mark.parametrize(("block", "marked"), [(20_000, 1 << 17), (7, 0)])
def test_large_buckets(spark, block, marked, monkeypatch):
    monkeypatch.setattr(setjoin, "MARKED", marked)
    rows = varied(3)
    docs = frame(spark, rows)
    got = sorted((r["kept_id"] is None, r["kept_id"] or 0) for r in simhash.near_copies(docs, star=3, block=block).collect())
    assert got == survivors(rows)


def test_fingerprints_of_sets():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 50)]
    got = setjoin.set_fingerprints(np.concatenate(sets), np.cumsum([0, 0, 1, 2, 50]))
    assert got.tolist() == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    for n in (0, 1, 64, 65, 300, 1000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for b in (a, a[: n * 4 // 5], np.append(a[n // 4 :], rng.integers(0, 1 << 63, n).astype(np.uint64))):
            apart = len(np.setxor1d(a, b))
            assert setjoin.parted(setjoin.parity(a), setjoin.parity(b)) <= apart
            assert setjoin.parted(setjoin.parity(b), setjoin.parity(a)) % 2 == apart % 2


def test_rows_without_own_id(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(5)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(1, texts[0]), (None, near), (None, texts[1]), (None, texts[2]), (None, texts[2] + " more"), (9, texts[3]), (9, texts[4])]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), SF).collect()]
    assert len(got) == 5 and {(1, texts[0]), (None, texts[1]), (9, texts[3]), (9, texts[4])} < set(got)
    assert [t for i, t in got if i is None and t.startswith(texts[2])]


def test_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.near_dedup(spark, docs.withColumns({"t0": F.lit(1), "kept_0": F.lit(2), "fp": F.lit(3)}), SF)
    assert got.columns == [*docs.columns, "t0", "kept_0", "fp"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == survivors(rows)
