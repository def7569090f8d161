import random

import brute
import pytest
from pyspark.sql import functions as F

from emberlake.llm import suffixarray


def test_collection_equals_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(120):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 8))]
        built = suffixarray.Collection(strings)
        rows = {i: b"" for i in range(len(strings))}
        for size, who, at in built.places():
            rows |= {int(a): strings[w][len(strings[w]) - size :] for w, a in zip(who, at, strict=True)}
        order = [rows[i] for i in range(len(rows))]
        assert order == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        for i in range(1, len(order)):
            a, b = order[i - 1], order[i]
            shared = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
            assert built.common[i] == shared


def test_gram_hashes_depend_on_their_bytes_only():
    import numpy as np

    for size in (1, 2, 3, 5, 20, 32):
        x = np.frombuffer(b"abcdefghij" * 12, np.uint8)
        h = suffixarray.gram_hashes(x, size)
        assert len(h) == len(x) - size + 1 and h[0] == h[10] and len(set(h.tolist())) == 10


def check(df, texts, length, **options):
    want = brute.repeated_bytes(texts, length)
    got = suffixarray.removal(df, length=length, **options).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").alias("n_spans"), "kept"
    ).collect()
    assert sorted((r[0] or 0, r[1], r[2], r[3], bytes(r[4])) for r in got) == sorted((i or 0, *want[i, t]) for i, t in texts)


@pytest.fixture(scope="module")
def passages():
    """Shared passages at other offsets, runs of one byte, copies."""
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))

    shared = [prose(40) for _ in range(3)]
    texts = []
    for i in range(40):
        text = prose(15) + rng.choice(shared)[rng.randrange(30) : rng.randrange(60, 200)] + prose(10)
        texts += [(i, text)] if i % 9 else [(i, text), (i + 1000, text)]
    texts += [(500, "a" * 300), (501, "ab" * 120), (502, "b" + "a" * 150)]
    return texts


@pytest.mark.parametrize("options", [{}, {"shard_strings": 3}, {"hot_rows": 2}, {"gram": 7}])
def test_passages(spark, passages, options):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(3)
    check(df, passages, 40, **({"gram": 12} | options))


def test_odd_documents(odd_docs, odd_texts, no_docs):
    short = [(i, t if t is None else t[:3000]) for i, t in odd_texts]
    check(odd_docs.withColumn("text", F.substring("text", 1, 3000)), short, 50)
    got = suffixarray.removal(odd_docs)
    assert dict(got.dtypes)["kept"] == "binary" and "lang" in got.columns and got.columns.count("spans") == 1
    assert suffixarray.removal(no_docs).count() == 0


def test_other_texts_under_one_id(spark):
    texts = [(1, "x" * 60 + "first"), (1, "other" + "y" * 60), (2, "y" * 60), (3, "zz")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixarray.removal(df, length=50).collect()}
    assert (2, 60, 60) in got and (3, 2, 0) in got
