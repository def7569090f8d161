import itertools
import math
import random

import public_tokenizers
import regex

from emberlake.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def best(model, word):
    """All segmentations, tried one by one."""
    top = None
    for cuts in itertools.product((0, 1), repeat=max(0, len(word) - 1)):
        places = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        parts = [word[a:b] for a, b in zip(places, places[1:])]
        if all(p in model.score or len(p) == 1 for p in parts):
            score = sum(model.score.get(p, model.unknown) for p in parts)
            if top is None or (round(score, 9), -len(parts)) > top:
                top = (round(score, 9), -len(parts))
    return -top[1], top[0]


def test_shared_prefixes_equal_all_segmentations():
    rng = random.Random(1)
    pieces = {b"a": 3, b"b": 1, b"ab": 0, b"ba": 2, b"aba": 5, b"bb": 4, b"abab": 6}
    model = tokencount.Unigram(pieces)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    rng.shuffle(words)
    for word, (n, score) in zip(words, model.counts(words), strict=True):
        want = best(model, word)
        assert math.isclose(score, want[1], abs_tol=1e-6) and n == want[0], word


def test_documents(odd_docs, no_docs, odd_texts):
    got = tokencount.counted(odd_docs, PATH, public_tokenizers.PATTERN, store_words=50, batch_chars=2000)
    model = tokencount.Unigram(tokencount.rank_table(PATH))
    rows = got.collect()
    assert len(rows) == len(odd_texts)
    by_size = {(i, len((t or "").encode())): regex.findall(public_tokenizers.PATTERN, t or "") for i, t in odd_texts}
    for r in rows:
        words = by_size[r["doc_id"], r["n_bytes"]]
        counts = model.counts([w.encode() for w in words]) if words else []
        assert r["n_pretokens"] == len(words) and r["n_tokens"] == sum(n for n, _ in counts)
        assert math.isclose(r["score"], sum(s for _, s in counts), rel_tol=1e-9, abs_tol=1e-9)
    assert tokencount.counted(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
