"""The corpus pipeline: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes what the one before kept: documents that the classifier rejects go; of each component of
near-duplicates (five-word shingles, similarity of at least 0.8) the document of smallest id stays; secrets in the
rest are masked; the mix repeats or thins out documents by source; the last stage gives ids of the byte-level BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lockstep.llm.bpe import decode, digests, encode
from lockstep.llm.common import materialise
from lockstep.llm.jaccard_join import keep_one
from lockstep.llm.mixing import mix_documents
from lockstep.llm.quality import fit, select_documents
from lockstep.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated ones among docs, keeps."""
    return select_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return keep_one(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix of all sources takes of each document."""
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix."""
    from public_tokenizers import path

    ranks = path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(docs, ranks), ranks))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("tokens", tokens)]

#: The classifier and the mix have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
