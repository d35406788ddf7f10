"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

1. toxicity: documents that score 0.7 or more go.
2. near_duplicates: one document of each group of near-duplicates (five words, similarity 0.8 or more) stays.
3. repeated_passages: byte strings of 50 that an earlier document has are taken out of later ones.
4. decontamination: documents in which a benchmark window of ten words occurs go.
5. encoding: doc_id, n_tokens and digests of the ids and of the text that they decode to.

Rows with a null doc_id pass through near_duplicates and repeated_passages as they are.  All but the last stage return
the columns of documents.  Null and empty texts are kept as the stages' operators state it, and an empty table of
documents gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm import bpe, common, decontam, minhash, suffixdedup, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, common.read(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars, where documents have it, is that of the text that is left."""
    out = suffixdedup.remove(docs, size=50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"), size=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", reject_toxic), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontaminate), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
