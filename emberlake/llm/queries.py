"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from emberlake.llm import (
    bpe,
    decontaminate,
    gam,
    hardneg,
    lexsearch,
    linededup,
    minhash,
    quality,
    suffixarray,
    suffixtree,
    tokencount,
    toxicity,
    urlfilter,
)
from emberlake.llm.common import table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_line_dedup(spark, sf_dir):
    done = linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_suffix_array(spark, sf_dir):
    done = suffixarray.removal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    chain = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.scored(documents.select("doc_id", "text"), chain).drop("text")


def op4_byte_bpe(spark, sf_dir):
    done = bpe.encoded(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.little_endian(F.col("ids"), VOCABULARY), 256).alias("ids_sha256"),
        F.sha2(bpe.decoded(F.col("ids"), VOCABULARY), 256).alias("decoded_sha256"),
    )


def op5_quality_rules(spark, sf_dir):
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judged(pages, urlfilter.PAGE_RULES).drop("url")


def op7_token_counts(spark, sf_dir):
    return tokencount.counted(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op8_minhash(spark, sf_dir):
    return minhash.linked(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return suffixtree.scored(table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_quality_classifier(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("id").cast("string")) % 5
    model = gam.fit(documents, table(spark, sf_dir, "labels"), training=fold != 0)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return gam.scored(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mined(table(spark, sf_dir, "embeddings"), anchor=F.col("id") % 100 == 0, label=label)


def op13_lexical_search(spark, sf_dir):
    return lexsearch.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_suffix_array, op3_toxicity, op4_byte_bpe, op5_quality_rules, op6_url_filter,
        op7_token_counts, op8_minhash, op9_lm_scoring, op10_decontamination, op11_quality_classifier, op12_hard_negatives,
        op13_lexical_search, pipeline,
    )
}
ORACLES = {
    "op1_line_dedup": linededup.SQL,
    "op5_quality_rules": quality.SQL,
    "op6_url_filter": urlfilter.SQL,
    "op12_hard_negatives": hardneg.SQL,
    "op13_lexical_search": lexsearch.SQL,
}
