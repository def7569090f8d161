"""Hard negatives by threshold joins over an inverted index with norm bounds.

Vectors are quantised to integers; a score is the integer inner product with an anchor. The anchors are the stated query set. They
are read in blocks of bounded size, and a block is broadcast with one threshold per anchor. A task takes the rows batch by batch and
builds the batch's inverted index for the lowest threshold: the leading dimensions of a row whose norm alone cannot bring the
row to a threshold are left out. An anchor adds up partial scores along the lists, last dimension first; a row is given up once its
partial score and the norms of what remains of both vectors stay below the threshold. Survivors are scored in full.

Thresholds start high and are lowered only for the anchors whose windows are not full yet:

1. Positives, the ``positives`` best other rows of the anchor's label: thresholds are taken from the anchor's scores with a bounded
   sample of rows. The sample decides where the search starts, never what it finds: an anchor is settled once enough rows
   reach its threshold, and the last round has none.
2. Negatives, per positive the ``negatives`` best rows of other labels with a score from ``low`` percent of the positive's up to the
   positive's own: thresholds fall from there to the end of the window.

Every task keeps the few best rows per window, so a vector that a third of all rows share makes no more rows than another.

Rows with a null id or label, a null vector or a null or non-finite component take no part. Shorter vectors are read as followed by
zeros. Scores are summed in doubles that hold them exactly: components so large that a score could pass 2^53 are an error. Ties go to the smaller id. Repeated rows are rows of their own; rows with the anchor's id are neither
its positives nor its negatives, and a repeated anchor is searched again. Windows under a negative positive are empty.
Only the named columns are read, so others of any name do not matter; a table without rows or without anchors gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.session import materialised

SCALE = 256
ANCHOR_BLOCK = 8_192
GROUP = 128
SAMPLE_ROWS = 4_096
STEP_DIMS = 8
# Negatives: shares of a positive's score at which thresholds stop on their way to the end of the window.
LEVELS = (95, 88)
EXACT = float(2**53)


class Index:
    """Inverted lists of a batch of rows for thresholds of at least ``least`` per unit of anchor norm.

    Rows are ordered by how many leading dimensions they leave out, so a list of a dense dimension is a leading
    slice of its column; a dimension that few rows hold keeps row numbers.
    """

    def __init__(self, rows: np.ndarray, least: float):
        n, dims = rows.shape
        norms = np.zeros((n, dims + 1))
        np.cumsum(rows**2, axis=1, out=norms[:, 1:])
        norms = np.sqrt(norms)
        # columns 0 .. left out - 1 have a norm below the threshold; a hair of slack for rounding
        left_out = (norms[:, 1:] * (1 + 1e-9) < least).sum(axis=1)
        self.order = np.argsort(left_out, kind="stable")
        self.rows = rows[self.order]
        norms, left_out = norms[self.order], left_out[self.order]
        self.left_norm = norms[np.arange(n), left_out]
        held = np.searchsorted(left_out, np.arange(dims), side="right")
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for d in range(dims):
            column = self.rows[: held[d], d]
            some = np.flatnonzero(column)
            if 2 * len(some) > len(column):
                self.lists.append((None, np.ascontiguousarray(column)))
            else:
                self.lists.append((some, column[some]))
        # norm of what remains of a row before dimension d, with the part left out
        self.before = [np.maximum(norms[:, d], self.left_norm) for d in range(dims)]

    def reaching(self, anchor: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of all rows of the batch that score at least the threshold."""
        n, dims = self.rows.shape
        rest = np.sqrt(np.concatenate([[0], np.cumsum(anchor**2)]))
        partial = np.zeros(n)
        alive = np.arange(n)
        for d in range(dims - 1, -1, -1):
            some, values = self.lists[d]
            if anchor[d]:
                if some is None:
                    partial[: len(values)] += anchor[d] * values
                else:
                    partial[some] += anchor[d] * values
            if d % STEP_DIMS == 0:
                # the anchor's part left out by a row may reach past d, but never past the whole
                most = np.where(self.before[d] > self.left_norm, rest[d], rest[-1]) * self.before[d]
                alive = np.flatnonzero(partial + most * (1 + 1e-9) >= threshold)
                if 16 * len(alive) <= n:
                    break
        scores = self.rows[alive] @ anchor
        fit = scores >= threshold
        return self.order[alive[fit]], scores[fit].astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, limit: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:limit]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a batch, followed by zeros where they are short."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def quantised(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, q) of the rows that take part; q holds floor(256 x)."""
    x = F.col(f"`{vector}`")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(x.isNotNull() & usable).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long")).alias("q"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull())


def _search(rows: DataFrame, shared, dims: int, limit: int, negatives: bool) -> DataFrame:
    """(anchor, slot, id, score): per anchor and window the best rows of each partition that reach the threshold.

    The broadcast holds ids, labels, vectors, thresholds and window tops of the anchors still open. A window takes scores up to
    its top; for positives there is one without top.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own_ids, own_labels, vectors, thresholds, tops = shared.value
        norms = np.sqrt((vectors**2).sum(axis=1))
        # alike thresholds share an index
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(norms > 0, thresholds / norms, -np.inf)
        by_unit = np.argsort(-unit, kind="stable")
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        floor = thresholds.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            matrix = _matrix(batch.column(2), dims)
            for start in range(0, len(by_unit), GROUP):
                group = by_unit[start : start + GROUP]
                index = Index(matrix, unit[group].min())
                for a in group:
                    found, scores = index.reaching(vectors[a], floor[a])
                    same = labels[found] == own_labels[a]
                    fit = (same != negatives) & (ids[found] != own_ids[a])
                    found, scores = ids[found[fit]], scores[fit]
                    if not len(found):
                        continue
                    full = []
                    for slot, top in enumerate(tops[a]):
                        if top == -np.inf:
                            continue
                        below = scores <= top
                        if below.any():
                            s, d = scores[below], found[below]
                            if (a, slot) in kept:
                                s = np.concatenate([kept[a, slot][0], s])
                                d = np.concatenate([kept[a, slot][1], d])
                            first = _best(s, d, limit)
                            kept[a, slot] = s[first], d[first]
                        have = kept.get((a, slot))
                        full.append(have[0][-1] if have and len(have[0]) == limit else -np.inf)
                    # nothing below the worst of full windows is wanted any more
                    floor[a] = max(floor[a], min(full, default=-np.inf))
        out = [(a, slot, s, d) for (a, slot), (s, d) in kept.items()]
        sizes = [len(s) for _, _, s, _ in out]
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([numbers[a] for a, _, _, _ in out], np.int64), sizes)),
                pa.array(np.repeat(np.array([slot for _, slot, _, _ in out], np.int64), sizes)),
                pa.array(np.concatenate([none, *[d for _, _, _, d in out]])),
                pa.array(np.concatenate([none, *[s for _, _, s, _ in out]])),
            ],
            ["anchor", "slot", "id", "score"],
        )

    found = rows.select("id", "label", "q").mapInArrow(search, "anchor long, slot long, id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


class Anchors:
    """A block of anchors on the driver; its size is bounded by ``ANCHOR_BLOCK``."""

    def __init__(self, rows: list, dims: int):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = np.zeros((len(rows), dims))
        for at, r in enumerate(rows):
            self.vectors[at, : len(r["q"])] = r["q"]

    def of(self, some: np.ndarray, thresholds: np.ndarray, tops: np.ndarray) -> tuple:
        return some, self.ids[some], self.labels[some], self.vectors[some], thresholds, tops


def _blocks(anchors: DataFrame, dims: int, size: int) -> Iterator[Anchors]:
    part = []
    for row in anchors.orderBy("id", "label", "q").toLocalIterator():
        part.append(row)
        if len(part) == size:
            yield Anchors(part, dims)
            part = []
    if part:
        yield Anchors(part, dims)


def _starts(block: Anchors, sample: Anchors, share: float, wanted: int) -> list[np.ndarray]:
    """Thresholds per round: the scores at some ranks among the sample's rows of the anchor's label, then none."""
    ranks = [max(1, int(np.ceil(2 * wanted * share * 8**k))) for k in range(3)]
    out = np.full((len(ranks) + 1, len(block.ids)), -np.inf)
    for a in range(len(block.ids)):
        alike = (sample.labels == block.labels[a]) & (sample.ids != block.ids[a])
        scores = np.sort(sample.vectors[alike] @ block.vectors[a])[::-1]
        for k, rank in enumerate(ranks):
            if rank <= len(scores):
                out[k, a] = scores[rank - 1]
    return list(out)


def mined(
    embeddings: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    anchor_block: int = ANCHOR_BLOCK,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    ``anchor`` is a predicate over the column ``id``. ``anchor_block`` and ``sample_rows`` bound what the driver holds and
    broadcasts at once; each block of anchors is searched against all rows.
    """
    spark = embeddings.sparkSession
    rows = materialised(quantised(embeddings, vec_id, vector, F.col("label") if label is None else label), "vectors")
    schema = (
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    out = spark.createDataFrame([], schema)
    size = F.array_max(F.transform("q", lambda c: F.abs(c.cast("double"))))
    n, dims, most = rows.agg(F.count("*"), F.max(F.size("q")), F.max(size)).first()
    if not n:
        return out
    if dims * (most or 0) ** 2 >= EXACT:
        raise ValueError(f"components up to {most:.0f} over {dims} dimensions: scores would not be exact")
    near = rows.orderBy(F.xxhash64("id"), "id", "label", "q").limit(sample_rows).collect()
    sample = Anchors(near, dims)
    for block in _blocks(rows.where(anchor), dims, anchor_block):
        found = _positives(spark, rows, block, sample, len(near) / n, dims, positives)
        out = out.unionByName(_negatives(spark, rows, block, found, dims, negatives, low))
    return out


def _positives(spark, rows, block, sample, share, dims, wanted) -> list[list[tuple[int, int]]]:
    """(score, id) of the best rows of its label, for each anchor of the block."""
    got: list[list[tuple[int, int]]] = [[] for _ in block.ids]
    open_ = np.arange(len(block.ids))
    levels = _starts(block, sample, share, wanted)
    for level, thresholds in enumerate(levels):
        if level + 1 < len(levels):
            # anchors whose sample is too small go on to a lower level at once
            now = open_[np.isfinite(thresholds[open_])]
        else:
            now = open_
        if not len(now):
            continue
        shared = spark.sparkContext.broadcast(block.of(now, thresholds[now], np.full((len(now), 1), np.inf)))
        # at most anchor_block x wanted rows
        fresh: dict[int, list[tuple[int, int]]] = {}
        for r in _search(rows, shared, dims, wanted, negatives=False).orderBy("anchor", "rank").collect():
            fresh.setdefault(r["anchor"], []).append((r["score"], r["id"]))
        for a in now:
            got[a] = fresh.get(a, [])
        open_ = np.array([a for a in open_ if len(got[a]) < wanted], int)
    return got


def _negatives(spark, rows, block, found, dims, wanted, low) -> DataFrame:
    """The block's result rows, written out."""
    width = max([len(f) for f in found], default=0)
    tops = np.full((len(found), max(1, width)), -np.inf)
    for a, f in enumerate(found):
        tops[a, : len(f)] = [score for score, _ in f]
    # smallest score of each window; a window under a negative score is empty
    ends = np.array([[-(-low * int(t) // 100) if t >= 0 else np.inf for t in row] for row in tops])
    wide = np.where(tops >= 0, tops, np.inf)
    settled = ~(tops >= 0)
    asked = [(a, s, int(t), found[a][s][1]) for a, row in enumerate(tops) for s, t in enumerate(row) if t >= 0]
    windows = spark.createDataFrame(
        [(a, s, int(block.ids[a]), i, t, int(ends[a, s])) for a, s, t, i in asked],
        "anchor long, slot long, anchor_id long, positive_id long, positive_score long, least long",
    )
    out = None
    for level in (*LEVELS, None):
        open_ = np.flatnonzero((~settled).any(axis=1))
        if not len(open_):
            break
        lowest = np.where(settled, np.inf, ends)
        if level is not None:
            lowest = np.maximum(lowest, np.where(settled, np.inf, wide * (level / 100)))
        thresholds = lowest[open_].min(axis=1)
        shown = np.where(settled, -np.inf, tops)[open_]
        shared = spark.sparkContext.broadcast(block.of(open_, thresholds, shown))
        hits = _search(rows, shared, dims, wanted, negatives=True)
        # windows: at most anchor_block x positives rows
        hits = hits.join(F.broadcast(windows), ["anchor", "slot"]).where(F.col("score") >= F.col("least"))
        hits = materialised(hits, "negatives")
        counts = {(r["anchor"], r["slot"]): r["count"] for r in hits.groupBy("anchor", "slot").count().collect()}
        done = []
        for at, a in enumerate(open_):
            for s in np.flatnonzero(~settled[a]):
                if counts.get((a, s), 0) == wanted or thresholds[at] <= ends[a, s]:
                    settled[a, s] = True
                    done.append((int(a), int(s)))
        ready = hits.join(
            F.broadcast(spark.createDataFrame(done, "anchor long, slot long")), ["anchor", "slot"], "left_semi"
        )
        out = ready if out is None else out.unionByName(ready)
    columns = ["anchor_id", "positive_id", "rank", "id", "positive_score", "score"]
    if out is None:
        out = windows.where("false").select("*", F.lit(0).alias("rank"), F.lit(0).alias("id"), F.lit(0).alias("score"))
    return out.select(*columns).toDF(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


SQL = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
           list_dot_product(a.q, r.q)::BIGINT AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
