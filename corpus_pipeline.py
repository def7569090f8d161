"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
``documents``; the last adds the ids of each text and the bytes they decode to.

A null text reads as an empty one, and an empty text has too few words to pass the first stage. Rows that repeat an id share its
fate in near_dedup and are judged one by one elsewhere; of equal texts the smallest id stays, of equal lines those of the
largest id. Rows without an id are never near-duplicates. Empty tables give empty results, and no items reject nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm import bpe, decontaminate, linededup, minhash, quality
from emberlake.llm.common import table, with_columns
from emberlake.session import materialised

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base test and the table of thresholds."""
    return quality.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of 40 characters or more that five documents hold, but for the largest id."""
    return with_columns(linededup.deduplicated(docs), n_chars=F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more stays."""
    return minhash.kept_rows(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a test item."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Id, number of tokens, the ids and the text they decode to."""
    done = bpe.encoded(docs, VOCABULARY, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.decode(bpe.decoded(F.col("ids"), VOCABULARY), "utf-8").alias("decoded"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


# The near-duplicate, edit-distance and merge stages cannot be written in SQL that ends in useful time.
ORACLE_SQL = None
