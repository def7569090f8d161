"""Quality scores by a generalised additive model with pairwise interactions.

Every text is measured by ``FEATURES``. A measure falls into one of a few bins, and the model is a constant, one lookup table per
measure and one grid per chosen pair of measures; a score is the logistic function of the sum of the entries of a text's bins. The
tables are learned by cyclic boosting: in each round every measure in turn gets one shallow tree on the current
gradients, whose leaf values, shrunk, are added to its table. Then the pairs whose quadrants best explain what is left are chosen, and
their grids are boosted the same way by trees of two levels. How many rounds stay is read from a part of the sample kept aside.

Labels come from the rows for which ``training`` holds. The model is fitted on a bounded sample of them: of either label the
``sample_docs`` (default 10,000) documents that come first by a hash of their id. A sample row weighs as many labelled documents as
it stands for, so scores refer to the share of labels among all training rows, whatever the size of the table. All rows and whole texts are
scored. Only the text enters a score, no label, language, source or id.

Null and empty texts measure 0 everywhere and get a score like any other. A null label is ignored; a document with several labels
counts as good if one of them says so, and of several texts under one id the smallest in the order of its measures is learned from.
Repeated rows are scored one by one, and a null id is neither held out nor learned from. Input columns named like a new one are
replaced. Without labels of both kinds the score is one constant: their share, or 0.5 without any label.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import split_words, text_of, with_columns
from emberlake.session import materialised

SAMPLE_DOCS = 10_000
BINS = 32
PAIR_BINS = 12
PAIRS = 10
ROUNDS = 150
PAIR_ROUNDS = 60
RATE = 0.1
LEAF_WEIGHT = 5.0
FEATURES = (
    "log_words", "word_chars", "longest_word", "distinct_words", "top_word", "again_words", "short_words",
    "letter_words", "upper_words", "title_words", "words_per_line", "dup_lines", "open_lines", "symbols", "marks",
    "digits", "stops", "byte_entropy", "packed",
)
SYMBOLS = b"#*$%&|<>~^=_{}[]\\@+"
_ENDS = (".", "!", "?", ":", ";", "…", "。")


def measures(text: str) -> list[float]:
    """The features of a text, in the order of FEATURES."""
    words = split_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    counts = Counter(words)
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    lengths = np.fromiter(map(len, words), np.int64, n)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    share = share[share > 0]
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(np.log1p(lengths.max())),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        float((lengths <= 3).mean()),
        sum(map(str.isalpha, words)) / n,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        sum(map(str.istitle, words)) / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for x in lines if not x.endswith(_ENDS)) / max(1, len(lines)),
        (size - len(raw.translate(None, SYMBOLS))) / size,
        (size - len(raw.translate(None, b"!?"))) / size,
        (size - len(raw.translate(None, b"0123456789"))) / size,
        (size - len(raw.translate(None, b".,;:"))) / n,
        float(-(share * np.log2(share)).sum()),
        len(zlib.compress(raw, 1)) / size,
    ]


@dataclass
class Additive:
    """Constant, bin edges and table per feature, coarser edges and grid per pair."""

    constant: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of measures: one vector addition per table."""
        z = np.full(len(x), self.constant)
        for f, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        used = {f for pair in self.pairs for f in pair}
        bins = {f: np.searchsorted(self.coarse[f], x[:, f], side="right") for f in used}
        for (i, j), grid in zip(self.pairs, self.grids, strict=True):
            z += grid[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def edges_of(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal weight; equal values share a bin."""
    order = np.argsort(values, kind="stable")
    values, reach = values[order], np.cumsum(weights[order])
    at = np.searchsorted(reach, reach[-1] * np.arange(1, bins) / bins)
    return np.unique(values[np.minimum(at, len(values) - 1)])


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1)


def _split(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best cut of ordered bins; cut 0 if none leaves enough weight on both sides."""
    left_g, left_h, left_w = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(w)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    gain = np.where((left_w >= LEAF_WEIGHT) & (w.sum() - left_w >= LEAF_WEIGHT), gain, -1.0)
    best = int(np.argmax(gain))
    return (float(gain[best]), best + 1) if gain[best] > 0 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Newton values of a tree of two levels over ordered bins, per bin."""
    out = np.empty(len(g))
    _, middle = _split(g, h, w)
    for a, b in ((0, middle), (middle, len(g))):
        if a == b:
            continue
        _, cut = _split(g[a:b], h[a:b], w[a:b])
        for c, d in ((a, a + cut), (a + cut, b)):
            if c < d:
                out[c:d] = g[c:d].sum() / (h[c:d].sum() + 1)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the better tree that cuts one axis and then each side on the other axis, and its gain."""
    best = (np.full(g.shape, g.sum() / (h.sum() + 1)), 0.0)
    whole = _gain(g.sum(), h.sum())
    for turned in (False, True):
        a, b, c = (g.T, h.T, w.T) if turned else (g, h, w)
        ga, ha, wa = (np.cumsum(m, axis=0) for m in (a, b, c))
        for cut in range(1, len(a)):
            gain, leaves = -whole, []
            for lo, hi, gs, hs, ws in (
                (0, cut, ga[cut - 1], ha[cut - 1], wa[cut - 1]),
                (cut, len(a), ga[-1] - ga[cut - 1], ha[-1] - ha[cut - 1], wa[-1] - wa[cut - 1]),
            ):
                side, at = _split(gs, hs, ws)
                gain += side + _gain(gs.sum(), hs.sum())
                leaves += [(lo, hi, 0, at, gs[:at], hs[:at]), (lo, hi, at, len(gs), gs[at:], hs[at:])]
            if gain > best[1]:
                values = np.zeros(a.shape)
                for lo, hi, x, y, gs, hs in leaves:
                    values[lo:hi, x:y] = gs.sum() / (hs.sum() + 1)
                best = (values.T if turned else values, gain)
    return best


class _State:
    """Current sums of the sample rows, their gradients, and the loss of the rows kept aside."""

    def __init__(self, y: np.ndarray, weights: np.ndarray, aside: np.ndarray, constant: float):
        self.y, self.v, self.aside = y, weights, aside
        self.learn = np.where(aside, 0.0, weights)
        self.z = np.full(len(y), constant)

    def gradients(self) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-self.z))
        return self.learn * (self.y - p), self.learn * p * (1 - p)

    def loss(self) -> float:
        some = self.aside if self.aside.any() else ~self.aside
        z = self.z[some]
        return float((self.v[some] * (np.logaddexp(0, z) - self.y[some] * z)).sum())


def _boost(state: _State, terms: list, rounds: int, patience: int = 15) -> list[np.ndarray]:
    """Cyclic boosting of (flat bin of every row, shape, tree) terms; the tables of the best round stay."""
    tables = [np.zeros(shape) for _, shape, _ in terms]
    best, kept, best_z, waited = state.loss(), [t.copy() for t in tables], state.z.copy(), 0
    weights = [np.bincount(bins, state.learn, int(np.prod(shape))).reshape(shape) for bins, shape, _ in terms]
    for _ in range(rounds):
        for k, (bins, shape, grow) in enumerate(terms):
            g, h = state.gradients()
            size = int(np.prod(shape))
            step = RATE * grow(
                np.bincount(bins, g, size).reshape(shape), np.bincount(bins, h, size).reshape(shape), weights[k]
            )
            tables[k] += step
            state.z += step.reshape(-1)[bins]
        now = state.loss()
        if now < best - 1e-9:
            best, kept, best_z, waited = now, [t.copy() for t in tables], state.z.copy(), 0
        else:
            waited += 1
            if waited == patience:
                break
    state.z = best_z
    return kept


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    weights: np.ndarray | None = None,
    aside: np.ndarray | None = None,
    pairs: int = PAIRS,
) -> Additive:
    """The model of rows of measures and labels 0 / 1; rows marked ``aside`` only decide when to stop."""
    v = np.ones(len(y)) if weights is None else weights
    aside = np.zeros(len(y), bool) if aside is None else aside
    if not len(y):
        return Additive()
    rate = float(np.clip((v * y).sum() / v.sum(), 1e-3, 1 - 1e-3))
    model = Additive(constant=float(np.log(rate / (1 - rate))))
    if not 0 < y[~aside].sum() < (~aside).sum():
        return model
    n, width = x.shape
    state = _State(y, v, aside, model.constant)
    model.edges = [edges_of(x[:, f], v, BINS) for f in range(width)]
    model.coarse = [edges_of(x[:, f], v, PAIR_BINS) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    model.tables = _boost(state, [(b, (len(e) + 1,), tree) for b, e in zip(bins, model.edges, strict=True)], ROUNDS)
    # pairs by what their quadrants would explain of the rest
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    g, h = state.gradients()
    ranked = []
    for i in range(width):
        for j in range(i + 1, width):
            shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
            flat = rough[i] * shape[1] + rough[j]
            size = shape[0] * shape[1]
            gain = pair_tree(*(np.bincount(flat, m, size).reshape(shape) for m in (g, h, state.learn)))[1]
            ranked.append((-gain, i, j, flat, shape))
    chosen = sorted((r for r in ranked if r[0] < 0), key=lambda r: r[:3])[:pairs]
    model.pairs = [(i, j) for _, i, j, _, _ in chosen]
    model.grids = _boost(state, [(flat, shape, lambda *m: pair_tree(*m)[0]) for *_, flat, shape in chosen], PAIR_ROUNDS)
    # tables average to nothing; their averages go to the constant
    for tables, rows in ((model.tables, bins), (model.grids, [r[3] for r in chosen])):
        for k, table in enumerate(tables):
            mean = float((v * table.reshape(-1)[rows[k]]).sum() / v.sum())
            table -= mean
            model.constant += mean
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the first column, a text, by its measures."""
    for batch in batches:
        rows = [measures(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["x", *batch.schema.names[1:]]
        )


def fit(
    documents: DataFrame,
    labels: DataFrame,
    training: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_docs: int = SAMPLE_DOCS,
) -> Additive:
    """A model of the labels where ``training``, a predicate over the column ``id``, holds.

    The driver gets at most 2 * sample_docs rows of measures.
    """
    ids = documents.select(F.col(f"`{doc_id}`").alias("id")).where(F.col("id").isNotNull()).where(training).distinct()
    known = (
        labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("double").alias("l"))
        .where(F.col("l").isNotNull() & training)
        .groupBy("id")
        .agg((F.max("l") > 0).cast("int").alias("y"))
        .join(ids, "id", "left_semi")
        .withColumn("h", F.xxhash64("id"))
    )
    known = materialised(known, "quality-labels")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    part = None
    for y in sorted(sizes):
        some = known.where(F.col("y") == y).orderBy("h", "id").limit(sample_docs)
        part = some if part is None else part.unionByName(some)
    if part is None:
        return Additive()
    # at most 2 * sample_docs ids
    part = materialised(part, "quality-ids")
    rows = documents.select(text_of(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").alias("id"))
    rows = rows.join(F.broadcast(part), "id").select("t", "id", "y", "h")
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), *rows.schema.fields[1:]])
    got = rows.mapInArrow(_measured, schema).groupBy("id").agg(F.min(F.struct("x", "y", "h")).alias("r"))
    got = sorted((r["r"]["h"], r["id"], r["r"]["y"], r["r"]["x"]) for r in got.collect())
    y = np.array([r[2] for r in got], float)
    stands = {k: n / min(n, sample_docs) for k, n in sizes.items()}
    least = min(stands.values())
    aside = np.array([r[0] >> 7 & 7 for r in got]) == 0
    return fit_additive(
        np.array([r[3] for r in got], float).reshape(len(got), len(FEATURES)),
        y,
        np.array([stands[r[2]] / least for r in got]),
        aside,
    )


def scored(
    df: DataFrame, model: Additive, text: str = "text", score: str = "score", predicted: str = "predicted", threshold: float = 0.3
) -> DataFrame:
    """Add the score and the int verdict to every row; the text and all other columns pass through."""
    new = {score.lower(), predicted.lower()}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new or c == text])
    schema = T.StructType([*df.schema.fields, T.StructField("__score", T.DoubleType())])
    # bounded: bins x (features + pairs)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            x = np.array([measures(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shared.value.scores(x))], schema.names)

    out = df.withColumn("__text", text_of(f"`{text}`")).mapInArrow(score_rows, schema)
    added = {score: F.col("__score"), predicted: (F.col("__score") >= threshold).cast("int")}
    return with_columns(out, **added).drop("__score")
