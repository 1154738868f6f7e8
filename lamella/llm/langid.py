"""Language identification in two steps: the family by linear SVMs, then the language within it.

A text's features are the shares of its hashed byte trigrams, lower case for A-Z. Linear support vector machines,
one against one, separate the families; others, one against one again, separate the languages of each family. A
prediction reads each byte of the whole text once and needs only a sum of weights.

Training uses a bounded sample of the labelled rows that it is given: PER_LANGUAGE texts a language, fewer where
there are so many languages that this exceeds SAMPLE texts, chosen by hash. Every language of those rows is learned,
in any script. Texts are turned into features where they are read; the driver gets the trigram classes that each
sampled text has and their counts. Families come from FAMILIES; a language that is not listed is a family of its own.

Null text, or text without a letter: `und` with score 0. Without any labelled text everything is `und`. Every row
gives a row, repeated rows and null ids too; extra columns are ignored. Of families or languages with the same votes the
first name wins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import raw, slices

PER_LANGUAGE = 400
#: Texts of all languages together that the fit takes.
SAMPLE = 12_000
BITS = 12
#: ISO 639-1 codes by family (fixed values).
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy yi".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg mk sr hr sl".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "semitic": "ar he mt am".split(),
    "indic": "hi bn ur mr pa gu".split(),
    "sinitic": "zh yue".split(),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def trigrams(flat: np.ndarray) -> np.ndarray:
    """The class of the trigram at each byte; the last two bytes have none (length - 2)."""
    low = _LOWER[flat].astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64)
    mixed = (low[:-2] * np.uint32(0x01000193) ^ low[1:-1]) * np.uint32(0x01000193) ^ low[2:]
    return ((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def profile(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Trigram classes and their counts, over the text between two spaces so that short texts have some."""
    classes, counts = np.unique(trigrams(np.frombuffer(b" " + text + b" ", np.uint8)), return_counts=True)
    return classes.astype(np.uint16), counts.astype(np.uint32)


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge linear SVM by accelerated gradient; y is -1 or 1.

    Products with x are taken in its own type: another type of vector would copy the whole matrix each time.
    """
    n = len(y)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, v, b, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    norm = float(weight @ np.einsum("ij,ij->i", x, x)) + 1
    rate = 1 / (1 / cost + 2 * norm)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v.astype(x.dtype) + vb))
        pull = weight * slack * y
        nw, nb = v - rate * (v / cost / n - 2 * (pull.astype(x.dtype) @ x)), vb + rate * 2 * pull.sum()
        v, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class Model:
    """Weights by trigram class of all one-against-one machines: first the families', then the languages'."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(k) for k in self.langs})
        scale = x.std(axis=0) + 1e-4
        x = x / scale
        lang, fam = np.array(langs), np.array([family(k) for k in langs])
        self.pairs: list[tuple[str, str]] = []
        weights, bias = [], []

        def train(labels, a, b):
            at = np.isin(labels, (a, b))
            w, c = _svm(x[at], np.where(labels[at] == a, 1.0, -1.0))
            margin = np.abs(x[at] @ w.astype(x.dtype) + c).mean() + 1e-9
            self.pairs.append((a, b))
            weights.append(w / scale / margin)
            bias.append(c / margin)

        for i, a in enumerate(self.families):
            for b in self.families[i + 1 :]:
                train(fam, a, b)
        self.n_family = len(self.pairs)
        for f in self.families:
            own = [k for k in self.langs if family(k) == f]
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    train(lang, a, b)
        self.weights = np.array(weights).T.astype(np.float32) if weights else np.zeros((1 << BITS, 0), np.float32)
        self.bias = np.array(bias, float)

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score for each row of machine margins."""

        def vote(names: list[str], first: int, pairs: list[tuple[str, str]]):
            if len(names) == 1:
                return np.zeros(len(margins), np.int64), np.ones(len(margins))
            total = np.zeros((len(margins), len(names)))
            for j, (a, b) in enumerate(pairs):
                p = 1 / (1 + np.exp(-np.clip(4 * margins[:, first + j], -30, 30)))
                total[:, names.index(a)] += p
                total[:, names.index(b)] += 1 - p
            best = total.argmax(1)
            return best, total[np.arange(len(best)), best] / (len(names) - 1)

        fam, sure = vote(self.families, 0, self.pairs[: self.n_family])
        out, score, first = np.empty(len(margins), object), np.zeros(len(margins)), self.n_family
        for k, f in enumerate(self.families):
            own = [x for x in self.langs if family(x) == f]
            n = len(own) * (len(own) - 1) // 2
            best, share = vote(own, first, self.pairs[first : first + n])
            at = fam == k
            out[at] = np.array(own, object)[best[at]]
            score[at] = (sure * share)[at]
            first += n
        return out.tolist(), np.clip(score, 0, 1)


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Fit on a bounded, hash-chosen sample of the rows for which `learn` holds and text and lang are set."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").count().collect()  # a row a language
    if not counts:
        return None
    per_language = max(1, min(per_language, sample // len(counts)))
    # By hash a few more than wanted, so that a language hardly ever falls short; the first of them are taken.
    most = per_language + 5 * math.sqrt(per_language) + 10
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in counts], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = rows.join(F.broadcast(share), "lang").withColumn("place", place).where("place < share").select("lang", "place", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            found = [profile((t or "").encode()) for t in batch.column("text").to_pylist()]
            columns = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("place"), *columns], names=["lang", "place", "classes", "counts"])

    by = Window.partitionBy("lang").orderBy("place", "classes", "counts")
    found = picked.mapInArrow(run, "lang string, place double, classes binary, counts binary").withColumn("rank", F.row_number().over(by))
    found = found.where(F.col("rank") <= per_language).collect()
    found = sorted((r["lang"], bytes(r["classes"]), bytes(r["counts"])) for r in found)
    if not found:
        return None
    x = np.zeros((len(found), 1 << BITS), np.float32)
    for k, (_, classes, n) in enumerate(found):
        n = np.frombuffer(n, np.uint32)
        x[k, np.frombuffer(classes, np.uint16)] = n / max(int(n.sum()), 1)
    return Model(x, [lang for lang, *_ in found])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts])
            names, score = ["und"] * len(texts), np.zeros(len(texts))
            if model is not None and lettered.any():
                # Each text between two spaces, one after another.
                flat, bounds = raw(batch.column("text"))
                n = np.diff(bounds)
                wide = np.full(len(flat) + 2 * len(n), 32, np.uint8)
                begin = bounds[:-1] + 2 * np.arange(len(n))
                wide[np.arange(len(flat)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = flat
                classes = trigrams(wide)
                margins = np.zeros((len(n), model.weights.shape[1]))
                own = n > 0
                for j in range(model.weights.shape[1]):
                    sums = np.concatenate(([0.0], np.cumsum(model.weights[:, j].astype(np.float64)[classes])))
                    margins[own, j] = (sums[(begin + n)[own]] - sums[begin[own]]) / n[own]
                got, sure = model.predict(margins + model.bias)
                names = [g if ok else "und" for g, ok in zip(got, lettered.tolist(), strict=True)]
                score = np.where(lettered, sure, 0.0)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_held_out(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lang").withColumn("held_out", held_out())
    return identify(docs, train(docs, ~F.col("held_out") & F.col("doc_id").isNotNull(), per_language))
