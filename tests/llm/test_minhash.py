import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from emberlake.llm import minhash


def check(df, texts, **options):
    groups, sizes = brute.near_groups(texts, options.get("percent", 85))
    rows = minhash.linked(df, **options).collect()
    assert len(rows) == len(texts)
    by = {}
    for i, t in texts:
        by.setdefault(i, set()).add(sizes[i, t])
    for r in rows:
        i = r["doc_id"]
        assert r["n_shingles"] in by[i]
        assert r["component_id"] == (groups[i] if i is not None else None)
        assert r["kept"] == (i is None or groups[i] == i)


def test_odd_documents(odd_docs, odd_texts, no_docs):
    check(odd_docs, odd_texts)
    check(odd_docs, odd_texts, percent=80)
    assert minhash.linked(no_docs).count() == 0


def variants(rng, n, base_words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randrange(edits + 1)):
            ws[rng.randrange(len(ws))] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def crowd():
    """Groups of copies around the threshold, a chain that links far ends, and singles."""
    rng = random.Random(11)
    texts = variants(rng, 60, 150, 3) + variants(rng, 25, 60, 2)
    chain = [f"c{i}" for i in range(200)]
    for _ in range(12):
        texts.append(" ".join(chain))
        at = rng.randrange(150)
        chain[at : at + 8] = [f"z{rng.randrange(10**6)}" for _ in range(8)]
    texts += [" ".join(f"s{rng.randrange(9000)}" for _ in range(80)) for _ in range(20)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small, pivots", [(16, 3), (2, 1), (10**6, 1)])
def test_crowds_equal_all_pairs(spark, crowd, monkeypatch, small, pivots):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    check(spark.createDataFrame(crowd, "doc_id long, text string"), crowd)


def test_kept_rows(spark, crowd):
    df = spark.createDataFrame([(i, t, "x") for i, t in crowd], "doc_id long, text string, component_id string")
    groups, _ = brute.near_groups(crowd, 80)
    kept = minhash.kept_rows(df, percent=80)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, g in groups.items() if i == g)


def test_bounds():
    assert (1 - 0.85**5) ** minhash.band_count(0.85, 5, 1e-8) <= 1e-8
    for n in (32, 160):
        m = minhash.least_matches(n, 0.85, 1e-6)
        assert 0 < m < 0.85 * n
    sets = minhash.shingle_sets(pa.array([["A", "b"], [], ["a", "b"], list("abcdef")]), 5)
    assert [len(s) for s in sets] == [1, 0, 1, 2] and sets[0] == sets[2]
    assert minhash.signatures([np.arange(1, 9, dtype=np.uint64) << np.uint64(32)], 12).shape == (1, 12)


def test_hubs_of_one_crowd_are_measured_once(spark):
    # hubs 1 and 2 are of one component and alike, 3 is of the component but unlike, 4 is alike but of another component
    spokes = [(1, 1, 0), (1, 2, 0), (1, 5, 5), (2, 1, 0), (2, 2, 0), (2, 6, 6), (3, 3, 0), (3, 7, 7), (4, 4, 4), (4, 8, 8)]
    like, unlike = np.arange(20, dtype=np.uint64), np.arange(90, 110, dtype=np.uint64)
    references = [(1, like), (2, like[1:]), (3, unlike), (4, like)]
    got = minhash._merged(
        spark.createDataFrame(spokes, "h long, nid long, label long"),
        spark.createDataFrame([(h, bytearray(r.tobytes())) for h, r in references], "h long, ref binary"),
        85,
    )
    rows = sorted(tuple(r) for r in got.select("h", "nid", "label").collect())
    assert rows == [(1, 1, 0), (1, 2, 0), (1, 5, 5), (1, 6, 6), (3, 3, 0), (3, 7, 7), (4, 4, 4), (4, 8, 8)]
