import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from emberlake.llm import suffixtree as st


def tokens(text):
    return brute.words((text or "").translate(brute.LOWER)) + ["\n"]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check_base(rows, texts):
    by = {}
    for i, t in texts:
        by.setdefault(i, []).append(tokens(t))
    c = Counter(w for i, t in texts if not is_held(i) for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    assert len(rows) == len(texts)
    for r in rows:
        ws = by[r["doc_id"]][0]
        assert r["held_out"] == is_held(r["doc_id"]) and r["n_tokens"] == len(ws) and r["train_tokens"] == total
        assert r["n_known"] == sum(c[w] > 0 for w in ws)
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("chunk", [300, 24_000_000])
def test_base_statistics(odd_docs, odd_texts, chunk):
    check_base(st.scored(odd_docs, chunk_chars=chunk).collect(), odd_texts)


def test_empty_table(no_docs):
    assert st.scored(no_docs).count() == 0


def chain_text(rng, n):
    """The next word depends on the last two."""
    out = ["a", "b"]
    for _ in range(n):
        out.append({"ab": "c", "bc": "d", "cd": "a"}.get(out[-2] + out[-1]) if rng.random() < 0.9 and out[-2] + out[-1] in ("ab", "bc", "cd") else rng.choice("abcdef"))
    return " ".join(out)


@pytest.fixture(scope="module")
def chain_rows(spark):
    rng = random.Random(9)
    texts = [(i, chain_text(rng, 200)) for i in range(120)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return texts, {r["doc_id"]: r for r in st.scored(df, chunk_chars=5000).collect()}


def test_contexts_help_on_held_out_text(chain_rows):
    texts, rows = chain_rows
    check_base(list(rows.values()), texts)
    held = [r for r in rows.values() if r["held_out"]]
    assert len(held) > 5
    assert all(r["score"] > r["base_score"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) > 0.05 * sum(r["n_tokens"] for r in held)


def test_independent_words_keep_no_context(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, " ".join(rng.choices("abcdef", k=300))) for i in range(60)], "doc_id long, text string")
    gains = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in st.scored(df).collect()]
    assert max(map(abs, gains)) < 0.02


def test_next_token_distributions_sum_to_one():
    rng = np.random.default_rng(3)
    symbols = np.sort(rng.integers(1, 1 << 62, 6).astype(np.uint64))
    root = np.array([0.3, 0.2, 0.15, 0.1, 0.1, 0.05])  # 0.1 is left for rare words
    context = st.mixed(np.ones(1, np.uint64), symbols[:1])
    level = (np.repeat(context, 3), np.zeros((3, 0), np.uint64), symbols[1:4], np.array([500, 300, 20]))
    tree = st.fit_tree([level], [(context, np.array([1000]))], (symbols, root))
    assert len(tree.states[0]) == 1
    probabilities = []
    for s, p in zip(symbols, root, strict=True):
        gain = tree.gains(np.array([symbols[0], s]), np.array([0]))[1]
        probabilities.append(p * 10**gain)
    rare = 0.1 * 10 ** tree.gains(np.array([symbols[0], 0], np.uint64), np.array([0]))[1]
    assert math.isclose(sum(probabilities) + rare, 1, rel_tol=1e-9)


def test_contexts_do_not_cross_documents():
    keys = st.context_keys(np.array([5, 6, 7], np.uint64), np.array([0, 2]), 2)
    assert keys[0][0] == 0 and keys[0][1] != 0 and keys[0][2] == 0 and not keys[1].any()


def tree_in_memory(texts, depth=3, least=8):
    """{id: score minus base score} by ``fit_tree`` on counts made in plain Python."""
    docs = {i: tokens(t) for i, t in texts}
    train = [ws for i, ws in docs.items() if not is_held(i)]
    c = [Counter(tuple(ws[k : k + n]) for ws in train for k in range(len(ws) - n + 1)) for n in range(1, depth + 2)]
    total = sum(c[0].values())
    symbol = {w: k + 1 for k, w in enumerate(sorted(w for (w,), n in c[0].items() if n >= least))}

    def key(gram):
        k = np.ones(1, np.uint64)
        for w in gram:
            k = st.mixed(k, np.array([symbol[w]], np.uint64))
        return int(k[0])

    levels, totals = [], []
    for n in range(1, depth + 1):
        some = [(g, x) for g, x in c[n].items() if x >= least]
        suffixes = [[key(g[j:-1]) for j in range(1, n)] for g, _ in some]
        levels.append(
            (
                np.array([key(g[:-1]) for g, _ in some], np.uint64), np.array(suffixes, np.uint64).reshape(len(some), n - 1),
                np.array([symbol[g[-1]] for g, _ in some], np.uint64), np.array([x for _, x in some]),
            )
        )
        sums = sorted((key(g[:-1]), c[n - 1][g[:-1]]) for g in {g[:-1] + ("",) for g, _ in some})
        totals.append((np.array([k for k, _ in sums], np.uint64), np.array([x for _, x in sums])))
    names = sorted(symbol, key=symbol.get)
    root = np.array([(c[0][(w,)] + 0.5) / (total + 0.5 * (len(c[0]) + 1)) for w in names])
    tree = st.fit_tree(levels, totals, (np.arange(1, len(names) + 1, dtype=np.uint64), root))
    coded = {i: np.array([symbol.get(w, 0) for w in ws], np.uint64) for i, ws in docs.items()}
    return tree, {i: tree.gains(s, np.array([0])).sum() for i, s in coded.items()}


def test_tree_in_tables_equals_the_one_in_memory(chain_rows):
    texts, rows = chain_rows
    tree, gains = tree_in_memory(texts)
    assert all(len(s) > 0 for s in tree.states[:2])
    for i, gain in gains.items():
        assert math.isclose(rows[i]["score"] - rows[i]["base_score"], gain, rel_tol=1e-9, abs_tol=1e-9)


def test_pairs_count_however_large_the_corpus(spark):
    """A pair seen 12 times among 4 million tokens is learned."""
    texts = [(i, "x " * 20_000 + ("seldom pair" if i < 15 else "")) for i in range(250)]
    assert 8 <= sum(not is_held(i) for i in range(15)) <= 15
    rows = st.scored(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r["train_tokens"] > 3_500_000 for r in rows)
    others = max(r["score"] - r["base_score"] for r in rows if r["doc_id"] >= 15)
    assert min(r["score"] - r["base_score"] for r in rows if r["doc_id"] < 15) > others + 3
