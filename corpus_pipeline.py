"""The corpus pipeline: quality, exact duplicates, near duplicates, private data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of documents. A stage begins with what executors gave back of the one before. run() writes each stage's result as Parquet to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, packing, pii, quality, simhash
from lodestone.llm.common import crc_fold, forget, stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier doesn't reject, learned without the fold that its query holds out.

    Null and empty texts are judged as the empty text; repeated rows and ids alike; without labels the share of ones with
    a prior of a half, 0.5, keeps every row. An empty table stays empty.
    """
    forget(spark)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").filter(crc_fold("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels), threshold=0.3)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each group of equal texts; null counts as empty, ids that repeat or are null name no group, of rows that agree in id and text one stays."""
    forget(spark)
    return exact_dedup.exact_dedup(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id of each group of near duplicates: word shingles of five, similarity 0.8 or more; nulls, ids and repeated rows as in unique()."""
    forget(spark)
    return simhash.near_dedup(docs, shingle=5, similarity=0.8)


def anonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private data replaced; n_chars follows the text. Null stays null; every row and column stays."""
    forget(spark)
    out = pii.replace_private(docs, key="lodestone")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and their places in sequences of 2048 tokens; a null or empty text is its end id alone."""
    forget(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, window=2048)


STAGES = [("quality", good), ("exact_dedup", unique), ("near_dedup", distinct), ("private_data", anonymous), ("packing", packed)]

#: No stage but exact dedup can be said in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
