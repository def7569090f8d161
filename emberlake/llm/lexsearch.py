"""Ranked lexical search, reversed: the items are indexed and the documents stream through.

The items are the fixed query set. They are read in blocks of bounded size; the inverted index of a block (term -> items) is
broadcast. One pass over the documents counts, per document, all its terms and the occurrences of those that some item holds, and
writes these counts. The corpus figures (documents with a term, their terms in all, documents per indexed term) are aggregates
of that table over all documents. A second pass sends the counts through the index: each term of a document adds its contribution to the
items on its list, and every task keeps the ``limit`` best documents of each item. These heaps are merged in two
steps, so that an item's heaps never meet in one task all at once.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; only A-Z is lower-cased. Weights and scores are
integers: a term weighs floor(1000 ln((2N+2)/(2df+1))), and a document of n terms adds for each item term
weight * (10^9 tf div (1000 tf + 8 m)), with m = 10 + 90 n N div L. Only scores above 0 are returned, higher ones first, then by smaller id.

Null and empty texts have no term: such documents count nowhere and such items find nothing. Repeated documents are ranked one by
one, each under its own rank, and a document without id comes after others of its score. Equal items and repeated item ids
are searched one by one. Only the named columns are read, so others of any name do not matter; tables without rows give none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.session import materialised

BLOCK_CHARS = 4_000_000
DOCS_AT_ONCE = 1_000
MERGE_GROUPS = 256
LAST_ID = np.iinfo(np.int64).max
# Separators become spaces and A-Z lower case; all other bytes, those of longer code points too, are parts of terms.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


class Index:
    """Terms of a block of items, numbered, and the items of each."""

    def __init__(self, items: list[bytes]):
        self.number: dict[bytes, int] = {}
        lists: list[list[int]] = []
        for at, text in enumerate(items):
            for term in sorted(set(terms(text))):
                k = self.number.setdefault(term, len(lists))
                if k == len(lists):
                    lists.append([])
                lists[k].append(at)
        self.lists = [np.array(x, np.int64) for x in lists]
        self.n_items = len(items)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The best documents of every item: score, id, at most ``limit`` of each."""

    def __init__(self, n_items: int, limit: int):
        none = np.zeros(0, np.int64)
        self.limit = limit
        self.best = [(none, none)] * n_items
        self.floor = np.ones(n_items, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents x items."""
        for item in np.flatnonzero((scores >= self.floor).any(axis=0)):
            fit = np.flatnonzero(scores[:, item] >= self.floor[item])
            s = np.concatenate([self.best[item][0], scores[fit, item]])
            d = np.concatenate([self.best[item][1], ids[fit]])
            first = np.lexsort((d, -s))[: self.limit]
            self.best[item] = s[first], d[first]
            if len(first) == self.limit:
                self.floor[item] = s[first[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        items = np.repeat(np.arange(len(self.best)), [len(s) for s, _ in self.best])
        return items, np.concatenate([d for _, d in self.best]), np.concatenate([s for s, _ in self.best])


def _blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[object, bytes]]]:
    part, size = [], 0
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.encode(F.col(f"`{text}`"), "UTF-8").alias("t"))
    for row in rows.orderBy("i", "t").toLocalIterator():
        body = bytes(row["t"] or b"")
        part.append((row["i"], body))
        size += len(body) + 16
        if size >= block_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counted(documents: DataFrame, shared, doc_id: str, text: str) -> DataFrame:
    """(id, n, ks, tfs): terms of a document in all, and the indexed ones with their occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.number
        for batch in batches:
            ns, ks, tfs = [], [], []
            for body in batch.column(1).to_pylist():
                own = terms(body)
                found = [(number[t], c) for t, c in Counter(own).items() if t in number]
                ns.append(len(own))
                ks.append([k for k, _ in found])
                tfs.append([c for _, c in found])
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(ks, many), pa.array(tfs, many)],
                ["id", "n", "ks", "tfs"],
            )

    narrow = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.encode(F.col(f"`{text}`").cast("string"), "UTF-8").alias("t")
    )
    counts = narrow.mapInArrow(count, "id long, n long, ks array<long>, tfs array<long>")
    return materialised(counts.where("n > 0"), "term-counts")


def _scored(counts: DataFrame, shared, weights: np.ndarray, n_docs: int, n_terms: int, limit: int) -> DataFrame:
    """(item, id, score): the best documents of each item in each partition."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index.n_items, limit)
        for whole in batches:
            for start in range(0, whole.num_rows, DOCS_AT_ONCE):
                batch = whole.slice(start, DOCS_AT_ONCE)
                ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
                # plain integers: the product may pass 64 bits
                m = np.array([10 + 90 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
                sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                ks = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                docs = np.repeat(np.arange(batch.num_rows), sizes)
                adds = weights[ks] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[docs]))
                by_term = np.argsort(ks, kind="stable")
                cuts = np.flatnonzero(np.diff(ks[by_term])) + 1
                scores = np.zeros((batch.num_rows, index.n_items), np.int64)
                for at in np.split(by_term, cuts) if len(ks) else []:
                    items = index.lists[ks[at[0]]]
                    scores[docs[at][:, None], items] += adds[at][:, None]
                heaps.offer(scores, ids)
        items, ids, scores = heaps.rows()
        none = pa.array(ids == LAST_ID)
        yield pa.RecordBatch.from_arrays(
            [pa.array(items), pa.array(ids, mask=none.to_numpy(zero_copy_only=False)), pa.array(scores)],
            ["item", "id", "score"],
        )

    return counts.select("id", "n", "ks", "tfs").mapInArrow(score, "item long, id long, score long")


def _first(heaps: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The best rows of each key, ranked."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def ranked(
    documents: DataFrame,
    items: DataFrame,
    limit: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(item id, rank, document id, score): the ``limit`` best documents of every item.

    ``block_chars`` bounds what is broadcast at once; each block of items is one more pass over the documents.
    """
    spark = documents.sparkSession
    kind = items.schema[item_id].dataType
    schema = T.StructType(
        [
            T.StructField(item_id, kind),
            T.StructField("rank", T.IntegerType()),
            T.StructField(doc_id, T.LongType()),
            T.StructField("score", T.LongType()),
        ]
    )
    out = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, block_chars):
        index = Index([body for _, body in block])
        shared = spark.sparkContext.broadcast(index)
        counts = _counted(documents, shared, doc_id, text)
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not index.lists:
            continue
        weights = np.zeros(len(index.lists), np.int64)
        # as many rows as the block has terms
        for row in counts.select(F.explode("ks").alias("k")).groupBy("k").count().collect():
            weights[row["k"]] = weight(n_docs, row["count"])
        heaps = _scored(counts, shared, weights, n_docs, n_terms, limit)
        heaps = heaps.withColumn("part", F.spark_partition_id() % MERGE_GROUPS)
        best = _first(_first(heaps, ["item", "part"], limit).drop("rank"), ["item"], limit)
        names = spark.createDataFrame(
            [(at, i) for at, (i, _) in enumerate(block)],
            T.StructType([T.StructField("item", T.LongType()), T.StructField(item_id, kind)]),
        )
        # the block's items: bounded like the index
        best = best.join(F.broadcast(names), "item").select(
            item_id, "rank", F.col("id").alias(doc_id), "score"
        )
        out = out.unionByName(materialised(best, "ranked"))
    return out


SQL = r"""
WITH terms AS (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
    FROM documents WHERE text IS NOT NULL
), docs AS (SELECT *, len(ts) AS n FROM terms WHERE len(ts) > 0),
corpus AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
counts AS (
    SELECT row, doc_id, n, t, count(*)::BIGINT AS tf
    FROM (SELECT row, doc_id, n, unnest(ts) AS t FROM docs) GROUP BY ALL
), asked AS (
    SELECT DISTINCT item_row, item_id, t FROM (
        SELECT row_number() OVER () AS item_row, item_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
        FROM benchmark WHERE text IS NOT NULL)
), weights AS (
    SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM counts, corpus WHERE t IN (SELECT t FROM asked) GROUP BY t, big_n
), scores AS (
    SELECT item_row, item_id, row, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
    FROM counts JOIN asked USING (t) JOIN weights USING (t), corpus GROUP BY ALL
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
