"""The pipeline's stages, each on what the one before kept."""

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import decontaminate, pii
from tests.llm.test_setjoin import survivors

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit("clash"))
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == inputs[name].columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0 and quality = 1").collect()}
    kept = {r["doc_id"] for r in inputs["near_dedup"].select("doc_id").collect()}
    assert len(toxic & kept) <= 0.5 * len(toxic) and len(good & kept) >= 0.95 * len(good)
    # Near duplicates: of each class of the stage's own input one is left, and no two that are left are near copies.
    before, after = inputs["near_dedup"].collect(), inputs["decontaminate"].collect()
    assert sorted((r["doc_id"], r["text"]) for r in after) == sorted({(i, t) for i, t in ((r["doc_id"], r["text"]) for r in before) if (False, i) in survivors([(r["doc_id"], r["text"]) for r in before])})
    texts = {r["text"] for r in before}
    assert len({r["text"] for r in after}) == len(after) <= len(texts)
    # Decontamination: exactly the documents with a passage went.
    index = decontaminate.Index([(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    leaked = {after[f[0]]["doc_id"] for f in index.scan(pa.array([r["text"] for r in after]))}
    assert {r["doc_id"] for r in inputs["personal_data"].collect()} == {r["doc_id"] for r in after} - leaked
    assert all(not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in inputs["packing"].collect())
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in inputs["packing"].collect()}


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "same words here", "en", "s", 1), (None, "same words here", "en", "s", 1), (7, None, None, None, None), (7, None, None, None, None), (8, "", "en", "s", 0)], docs.schema)
    for frame, most in ((docs.limit(0), 0), (odd, 5)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns and out.count() <= most, name
    kept = corpus_pipeline.near_dedup(spark, odd, SF).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["7", "None"]
