"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of documents, and whatever other
columns docs has. Every stage decides on its own input; null texts count as empty, and the operators' docstrings
say what null ids, repeated rows and empty tables give.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontaminate, packing, pii, quality, setjoin, simhash
from lamella.llm.common import small_batches, table
from lamella.session import shared_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model finds good; those that it rejects, toxic ones among them, go."""
    return quality.select(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id, of equal rows one.

    SimHash fingerprints give the first links, an exact join of the sets what they cannot reach (simhash.near_copies).
    Near duplicates have sets of five-word shingles with a Jaccard similarity of 0.8 or more; a class is what chains
    of them join. Rows with a null doc_id, or with different texts under one doc_id, are judged by their texts like all
    others; a null doc_id comes after all others in a class. Texts without words form a class.
    """
    small_batches(spark)
    first = simhash.near_copies(docs, width=5)
    t0, t1 = setjoin.row_hashes(docs)
    own = "row" + "_" * max(map(len, docs.columns))  # no column's name
    rows = docs.withColumns({own + "0": t0, own + "1": t1})
    rows = rows.join(first.select(F.col("kept_0").alias(own + "0"), F.col("kept_1").alias(own + "1")), [own + "0", own + "1"], "left_semi")
    return rows.dropDuplicates([own + "0", own + "1"]).select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text replaced by its kind in angle brackets; n_chars follows."""
    small_batches(spark)
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", benchmark_filter),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: No stage's learned or fingerprinting part can be put in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
