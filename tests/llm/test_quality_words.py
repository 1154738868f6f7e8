"""The quality model uses words at every size of its sample."""

import numpy as np
import pyarrow as pa

from lamella.llm import quality


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    common = [f"plain{k}" for k in range(60)]
    out, grade = [], []
    for i in range(n):
        words = list(rng.choice(common, 40))
        if i % 3 == 0:
            words[5] = "awfulword"
        out.append(" ".join(words))
        grade.append(0 if i % 3 == 0 else 2 - (i % 3 == 1 and i % 2))
    return pa.array(out), np.array(grade)


def test_words_count_in_small_and_large_samples():
    for n in (60, 600):
        texts, grade = _texts(n, 1)
        doc, bucket, shapes = quality.features(texts)
        model = quality.Model(doc, bucket, shapes, grade)
        assert 0 < (model.weights != 0).sum() <= quality.WORDS
        fresh, want = _texts(90, 2)
        scores = model.scores(fresh)
        assert scores[want == 0].max() < scores[want > 0].min()


def test_long_repeated_and_tied_texts(spark):
    text = "word " * 200_000
    rows = [(1, text), (1, text), (2, text), (None, "a b"), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, labels)
    got = quality.score(frame, model).collect()
    assert len(got) == 6
    assert len({(r["expected_grade"], r["p_good"]) for r in got if r["doc_id"] in (1, 2)}) == 1
    assert all(0 <= r["p_good"] <= 1 and r["keep"] == (r["p_good"] >= 0.5) for r in got)
