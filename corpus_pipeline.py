"""The corpus pipeline: toxicity, near-duplicates, benchmark contamination, secrets, encoding, in this order.

Every stage works on all that the one before it kept; its table is written and read again, so a lost executor costs
a re-read. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm import bpe, decontamination, near_dedup, secrets, toxicity
from siltmark.llm.common import table
from siltmark.sources.durable import stored


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows that are not in ``rejected`` (doc_id, text_hash): rows that repeat an id, or have none, go by their own text."""
    gone = rejected.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted to this table's labelled rows, does not reject."""
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scores = stored(toxicity.score_toxicity(docs, net), "toxicity")
    return _without(docs, scores.where("predicted = 1"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: that of the smallest doc_id. Rows without a doc_id stay."""
    groups = stored(near_dedup.near_duplicates(docs), "groups")
    return docs.join(groups.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not repeat the benchmark."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted anew."""
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The network and the encoder are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
