"""From raw documents to packed training sequences: reject toxic texts, keep one of each near-duplicate group, mask
secrets, pack. Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import jaccard, packing, secret_scan, toxicity
from tidemark.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below one half.

    Rows are judged one by one, repeated and null ids included; a null text counts as empty. Without labels of both classes, and
    on an empty table, nothing goes."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of similar ones; repeated rows once.

    Rows of one id with unequal texts are looked at one by one. Null and empty texts are similar to nothing and stay, each id
    once; rows without an id stay. An empty table stays empty."""
    return jaccard.representatives(docs, n=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mask; null texts and all other columns stay as they are, n_chars follows."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens.

    Null text counts as empty: the end id alone. Repeated rows are packed as often as they stand; an empty table gives no rows.
    Workers that have run the stages before hold less memory for known chunks than those of packing alone.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 0, with_ids=False, remember=250_000)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = scratch.table(out)
    return out
