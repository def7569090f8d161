import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from emberlake.llm import bpe, tokencount

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = tokencount.rank_table(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fold_and_heap_equal_the_library(spark, library):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"aeinrst th") for _ in range(rng.randint(1, 40))).decode() for _ in range(150)]
    words += ["é", "漢字漢字", "\U0001f600", " the", "ẞßé" * 9, "aaaaaaaaaaaaaaaaaaaaaaa"]
    want = {w: library._core_bpe.encode_single_piece(w.encode()) for w in words}
    got = bpe.encoded_words(spark.createDataFrame([(w,) for w in set(words)], "word string"), PATH).collect()
    assert {r["word"]: r["ids"] for r in got} == want
    ranks = tokencount.rank_table(PATH)
    assert all(bpe.heap_encode(w.encode(), ranks) == ids for w, ids in want.items())


@pytest.mark.parametrize("chunk", [200, 24_000_000])
def test_documents(odd_docs, odd_texts, library, chunk):
    got = bpe.encoded(odd_docs, PATH, public_tokenizers.PATTERN, chunk_chars=chunk)
    got = got.withColumn("back", bpe.decoded(F.col("ids"), PATH)).withColumn("raw", bpe.little_endian(F.col("ids"), PATH))
    rows = got.collect()
    want = sorted((i or 0, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_texts)
    assert sorted((r["doc_id"] or 0, r["ids"], bytes(r["back"])) for r in rows) == want
    assert all(bytes(r["raw"]) == b"".join(i.to_bytes(4, "little") for i in r["ids"]) for r in rows)


def test_text_beyond_the_older_unicode_tables(spark, library):
    # letters that were added to Unicode after Java 17's tables
    text = "old \U0001df00\U0001df04 new \U00011f04x 9\U0001e4f0"
    df = spark.createDataFrame([(1, text), (2, "plain text")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {1: library.encode_ordinary(text), 2: library.encode_ordinary("plain text")}


def test_empty_table(no_docs):
    assert bpe.encoded(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
