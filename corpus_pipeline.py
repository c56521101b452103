"""A corpus pipeline over the operators for training data.

Each stage works on all that the one before it kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tristage.llm import exact_dedup, jaccard, packing, secrets, toxicity
from tristage.llm.columns import free_name, table
from tristage.llm.queries import REJECT, WORD_BPE, tokenizer_path, toxicity_network
from tristage.session import scratch_path


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go."""
    name = free_name("_toxicity", docs.columns)
    scored = toxicity.score(docs, toxicity_network(spark, sf_dir), score_col=name)
    return scored.where(F.col(name) < REJECT).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts, the document with the smallest id stays."""
    return jaccard.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the spans reported as secrets leave its text, and n_chars follows where there is one."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean.select(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences: every piece of every document with its ids and its place."""
    # The workers still hold memory of the stages before, so this one keeps fewer words than op4.
    pieces = packing.token_pieces(docs, tokenizer_path(WORD_BPE), cache_words=120_000)
    return packing.pack(pieces)


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]
# The network and the tokenizer have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
