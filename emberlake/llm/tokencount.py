"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a batch are put into a trie. The best score of every prefix is worked out
once per trie node, so pre-tokens that share a prefix share its scores; the counts at the terminal
nodes are then summed per document. Nothing is shuffled and nothing grows with the corpus: a task
holds one batch and a store of finished pre-tokens of bounded size.

Scores: the vocabulary is a public rank file and is not trained. By Zipf's law a piece of rank r weighs
``-ln(r + 2)``, less the log of the sum of all weights. The best segmentation has the largest sum; on ties the
fewest pieces. A byte that no piece covers counts as one token and scores like the last rank.
Null and empty texts have no tokens. Repeated rows are counted one by one.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import text_of


def rank_table(path: str) -> dict[bytes, int]:
    """Pieces and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Unigram:
    """Piece scores, with the pieces filed by their reversed bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        total = math.log(sum(1 / (r + 2) for r in ranks.values())) if ranks else 0.0
        self.score = {p: -math.log(r + 2) - total for p, r in ranks.items()}
        self.lengths: dict[int, list[int]] = {}
        by_end: dict[int, set[int]] = {}
        for piece in self.score:
            if piece:
                by_end.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {byte: sorted(n) for byte, n in by_end.items()}
        self.unknown = -math.log(max(ranks.values(), default=0) + 2) - total

    def counts(self, words: list[bytes]) -> list[tuple[int, float]]:
        """Tokens and score of each word.

        The words are visited in sorted order. ``best`` is the path of trie nodes from the root to the
        current one: a new word goes back to the node where it leaves the last word and only adds
        what lies below.
        """
        done: dict[bytes, tuple[int, float]] = {}
        best: list[tuple[float, int]] = [(0.0, 0)]
        last = b""
        score, lengths = self.score, self.lengths
        for word in sorted(set(words)):
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                before = best[end - 1]
                top = None
                for n in lengths.get(word[end - 1], ()):
                    if n > end:
                        break
                    s = score.get(word[end - n : end])
                    if s is not None:
                        base = best[end - n]
                        here = (base[0] + s, base[1] - 1)
                        if top is None or here > top:
                            top = here
                best.append(top if top is not None else (before[0] + self.unknown, before[1] - 1))
            done[word] = (-best[-1][1], best[-1][0])
            last = word
        return [done[w] for w in words]


def counted(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    store_words: int = 500_000,
    batch_chars: int = 8_000_000,
) -> DataFrame:
    """One row per input row: its id, n_bytes, n_pretokens, n_tokens and score (natural log).

    ``vocabulary`` is the path of the rank file, the same on driver and executors. ``store_words`` bounds the
    finished pre-tokens a task keeps between batches; the store is emptied when full.
    """
    ranks = rank_table(vocabulary)
    schema = T.StructType(
        [
            T.StructField(doc_id, df.schema[doc_id].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_pretokens", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    shared = df.sparkSession.sparkContext.broadcast(ranks)  # bounded: one vocabulary file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(shared.value)
        split = regex.compile(pattern)
        store: dict[str, tuple[int, float]] = {}

        def rows(ids, texts):
            counted_words = [Counter(split.findall(t)) for t in texts]
            fresh = list({w for c in counted_words for w in c if w not in store})
            if len(store) + len(fresh) > store_words:
                store.clear()
                fresh = list({w for c in counted_words for w in c})
            store.update(zip(fresh, model.counts([w.encode("utf-8") for w in fresh]), strict=True))
            sizes, pre, tokens, scores = [], [], [], []
            for t, c in zip(texts, counted_words, strict=True):
                sizes.append(len(t.encode("utf-8")))
                pre.append(sum(c.values()))
                tokens.append(sum(store[w][0] * n for w, n in c.items()))
                scores.append(math.fsum(store[w][1] * n for w, n in c.items()))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(pre, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(scores, pa.float64())],
                schema.names,
            )

        for batch in batches:
            texts = batch.column(1).to_pylist()
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= batch_chars or i == len(texts) - 1:
                    yield rows(batch.column(0).slice(start, i + 1 - start), texts[start : i + 1])
                    start, size = i + 1, 0

    return df.select(F.col(f"`{doc_id}`"), text_of(f"`{text}`").alias("__text")).mapInArrow(count, schema)
