"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score): one score, a sum of weights of the hashed words that a text has and
of a few shape features, shared by all grades, and ordered thresholds. The expected grade and the tail probability
P(grade >= k) select documents. Grades from `labels`: 0 toxic, 1 of low quality, 2 good. The words are the WORDS ones
that go most with a grade in the sample, whatever its size; the less sure that is, the more their weight is drawn to zero.

Training uses a bounded, hash-chosen sample of at most SAMPLE labelled documents. Scoring reads the whole text and
sends nothing anywhere. Null text is an empty text. Every row gives a row, repeated rows and null ids too; several
labels of one document count by the lowest grade, and of several texts under one id one is learned from. Without labels every document is kept with grade 2. Extra
columns are ignored by score() and kept by select().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import raw, slices, span_hashes, word_bounds

SAMPLE = 8000
BUCKETS = 1 << 18
GRADES = 3
SHAPES = 8
#: Bytes of a longer word's head, which is a feature beside the word.
HEAD = 5
#: The words and heads that go most with a grade: so many are used at every size of the sample.
WORDS = 1024
#: Weights of words are drawn to zero the more, the further the z-score of their association is below this.
STRONG_Z = 5.0
#: How steeply.
POWER = 12
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, bucket) of the distinct hashed words and heads of each text, and SHAPES shape features.

    Words are in lower case without marks at their ends; a word of marks only stays. Shapes: shares of words that
    repeat the word before, of words with two or more end marks, of words of marks only, of words in capitals, of
    words with digits, each times 8 up to 1; the mean word length over 20; 1; the log of the count of words over 10.
    """
    flat, bounds = raw(column)
    starts, ends, before = word_bounds(flat, bounds)
    n_docs, n = len(bounds) - 1, len(starts)
    shapes = np.zeros((n_docs, SHAPES))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), shapes
    low = _LOWER[flat]
    a, b = starts.copy(), ends.copy()
    tail = np.zeros(n, np.int64)
    for _ in range(6):
        cut = (b > a) & _MARK[flat[np.maximum(b - 1, 0)]]
        b[cut] -= 1
        tail += cut
        cut = (b > a) & _MARK[flat[np.minimum(a, len(flat) - 1)]]
        a[cut] += 1
    empty = a >= b
    a[empty], b[empty] = starts[empty], ends[empty]
    words = span_hashes(low, a, b)
    doc = np.repeat(np.arange(n_docs), np.diff(before))
    same = np.zeros(n, bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    upper = np.concatenate(([0], np.cumsum(_UPPER[flat])))
    digit = np.concatenate(([0], np.cumsum((flat >= 48) & (flat <= 57))))
    counts = np.maximum(np.diff(before), 1)
    columns = (same, tail >= 2, empty, (upper[b] - upper[a]) >= np.maximum(b - a, 2), digit[b] > digit[a], np.minimum(ends - starts, 40) / 20)
    for j, values in enumerate(columns):
        share = np.bincount(doc, values.astype(float), n_docs) / counts
        shapes[:, j] = np.minimum(share * 8, 1) if j < 5 else share
    shapes[:, 6] = 1
    shapes[:, 7] = np.log1p(np.diff(before)) / 10
    heads = span_hashes(low, a, np.minimum(a + HEAD, b), salt=1)
    long = b - a > HEAD
    buckets = np.concatenate((words, heads[long])) % np.uint64(BUCKETS)
    pairs = np.unique(np.concatenate((doc, doc[long])) * BUCKETS + buckets.astype(np.int64))
    return pairs // BUCKETS, pairs % BUCKETS, shapes


class Model:
    """weights by bucket, shape weights and thresholds; fitted by Adam on the ordinal log-likelihood."""

    def __init__(self, doc: np.ndarray, bucket: np.ndarray, shapes: np.ndarray, grade: np.ndarray, rounds: int = 500, ridge: float = 1e-4, seen: int = 3):
        n = len(grade)
        # The buckets that go most with a grade: by the z-score of a grade's share among the texts that have the bucket.
        total = np.bincount(bucket, minlength=BUCKETS).astype(float)
        telling = np.zeros(BUCKETS)
        for k in range(GRADES):
            share = (grade == k).mean()
            got = np.bincount(bucket, (grade[doc] == k).astype(float), BUCKETS)
            z = (got - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
            telling = np.maximum(telling, np.where(total >= seen, np.abs(z), 0.0))
        keep = np.zeros(BUCKETS, bool)
        keep[np.argsort(-telling, kind="stable")[:WORDS]] = True
        keep = (keep & (telling > 0))[bucket]
        doc, bucket = doc[keep], bucket[keep]
        names, at = np.unique(bucket, return_inverse=True)
        pull = np.maximum(1.0, (STRONG_Z / np.maximum(telling[names], 0.1)) ** POWER) * ridge
        k = GRADES - 1
        size = len(names)
        share = np.bincount(grade, minlength=GRADES) / n
        weight = 1 / np.maximum(share, 0.02)[grade] ** 0.5
        weight /= weight.mean()
        start = np.log(np.clip(np.cumsum(share)[:k], 0.01, 0.99) / (1 - np.clip(np.cumsum(share)[:k], 0.01, 0.99)))
        p = np.concatenate((np.zeros(size + SHAPES), [start[0]], np.log(np.maximum(np.diff(start), 0.1))))
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, rounds + 1):
            w, u, raw_theta = p[:size], p[size : size + SHAPES], p[size + SHAPES :]
            theta = raw_theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw_theta[1:]))))
            s = np.bincount(doc, w[at], n) + shapes @ u
            below = 1 / (1 + np.exp(-np.clip(theta[None, :] - s[:, None], -30, 30)))
            full = np.concatenate((np.zeros((n, 1)), below, np.ones((n, 1))), axis=1)
            rows = np.arange(n)
            prob = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
            slope = full * (1 - full)
            d_up, d_low = weight * slope[rows, grade + 1] / prob, weight * slope[rows, grade] / prob
            gs = (d_up - d_low) / n  # of the loss by the score
            g_theta = np.zeros(k)
            for j in range(k):
                g_theta[j] = -d_up[grade == j].sum() / n + d_low[grade == j + 1].sum() / n
            g_raw = np.concatenate(([g_theta.sum()], [g_theta[j:].sum() * np.exp(raw_theta[j]) for j in range(1, k)]))
            g = np.concatenate((np.bincount(at, gs[doc], size) + pull * w, shapes.T @ gs + ridge * u, g_raw))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.weights = np.zeros(BUCKETS, np.float32)
        self.weights[names] = p[:size]
        self.shapes, raw_theta = p[size : size + SHAPES], p[size + SHAPES :]
        self.thresholds = raw_theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw_theta[1:]))))

    def scores(self, column: pa.Array) -> np.ndarray:
        doc, bucket, shapes = features(column)
        return np.bincount(doc, self.weights[bucket].astype(float), len(shapes)) + shapes @ self.shapes

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -30, 30)))


def grades(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    graded = grades(labels)
    total = graded.count()
    if not total:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # At most about 2 * sample ids of eight bytes: the bound of the broadcast.
    picked = graded.where(place < min(1.0, sample / total)).limit(2 * sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches):
        for batch in slices(batches, "text"):
            doc, bucket, shapes = features(batch.column("text"))
            cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            data = [bucket[cuts[k] : cuts[k + 1]].astype(np.int32).tobytes() for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array(data, pa.binary()), pa.array([x.tobytes() for x in shapes], pa.binary())], names=["doc_id", "grade", "words", "shapes"])

    # Features, not texts, are sent on, and one row an id, however many rows share it.
    found = texts.mapInArrow(run, "doc_id long, grade int, words binary, shapes binary")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("words", "shapes", "grade")).alias("f")).select("doc_id", "f.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return None
    words = [np.frombuffer(r["words"], np.int32).astype(np.int64) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(w) for w in words])
    return Model(doc, np.concatenate(words), np.array([np.frombuffer(r["shapes"]) for r in rows]), np.array([r["grade"] for r in rows]))


def _rated(model: Model | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= 2)."""
    if model is None:
        return np.full(len(column), float(GRADES - 1)), np.ones(len(column))
    tails = model.tails(model.scores(column))
    return tails.sum(1), tails[:, -1]


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, p_good, keep) for each row."""

    def run(batches):
        for batch in slices(batches, "text"):
            expected, good = _rated(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(good), pa.array(good >= least)], names=["doc_id", "expected_grade", "p_good", "keep"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, expected_grade double, p_good double, keep boolean")


def select(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose tail probability is `least` or more, with all their columns."""

    def run(batches):
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(_rated(model, batch.column("text"))[1] >= least))

    return docs.mapInArrow(run, docs.schema)
