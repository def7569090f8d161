"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each category has a logistic model over word features
and the probabilities of all earlier categories. For training, the earlier probabilities are out-of-fold
predictions, so a later model sees them as noisy as they will be on new text; the models kept
are then fitted on the whole sample.

The last category is the label of the table. An earlier category is a positively labelled document that holds one of the
category's seed words, which are given in English, French, German and Spanish. A positively labelled document without a seed
word of any category (another language, other words) may belong to each of them, so the earlier models are fitted without it; the last
one sees it. A category without positive or negative cases gets a constant model.

Features are lower-cased words and word starts of 3 to 6 letters, chosen by how much more often they
occur in labelled documents than in others. Copies would pass for evidence, so of documents with the same smallest
shingle hash, under any of three seeds, one stays in the sample. The sample is bounded: the ``sample_docs`` labelled documents of
either label that come first by a hash of their id (a documented bound, default 5,000 each). Sampling and thinning change the
share of positive labels, so a sample row weighs as many labelled documents as it stands for: the labels of all labelled documents
are counted, and probabilities and verdicts refer to their share, whatever the size of the table. Scoring covers all
rows and whole texts. Null and empty texts have no feature. Labels that are null are ignored; a document with several labels counts
as positive if one of them is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake.llm.common import text_of, with_columns
from emberlake.session import materialised

WORDS = re.compile(r"[^\W\d_]+")
STARTS = (3, 4, 5, 6)
SAMPLE_DOCS = 5_000
MAX_FEATURES = 600
FOLDS = 5
THINNING = 3

# Seed words of the earlier categories, by meaning.
SEEDS = {
    "insult": (
        "clown", "fool", "idiot", "jerk", "loser", "moron", "scum", "trash",
        "abruti", "abrutie", "connard", "connasse", "crétin", "crétine", "idiote", "imbécile", "ordure", "salaud",
        "abschaum", "arschloch", "depp", "dummkopf", "drecksack", "trottel", "versager", "vollidiot",
        "basura", "escoria", "gilipollas", "idiota", "imbécil", "payaso", "payasa", "perdedor", "perdedora",
    ),
    "contempt": (
        "disgusting", "pathetic", "stupid", "useless", "worthless",
        "dégoûtant", "dégoûtante", "méprisable", "minable", "pathétique", "stupide",
        "dumm", "ekelhaft", "erbärmlich", "nutzlos", "widerlich", "wertlos",
        "asqueroso", "asquerosa", "despreciable", "estúpido", "estúpida", "inútil", "patético", "patética",
    ),
    "threat": (
        "beat", "burn", "hurt", "kill", "shoot", "stab",
        "brûler", "frapper", "poignarder", "tuer", "tuerai",
        "erschießen", "erstechen", "töten", "umbringen", "verbrennen", "verprügeln",
        "apuñalar", "disparar", "golpear", "matar", "mataré", "quemar",
    ),
}


def features(text: str) -> set[str]:
    """Words, and word starts marked with a star."""
    words = set(WORDS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STARTS if len(w) >= n}


@dataclass
class Linear:
    """Weights over the features and the earlier categories, and a constant."""

    weights: np.ndarray
    constant: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.constant, -30, 30)))


@dataclass
class Chain:
    vocabulary: dict[str, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    models: list[Linear] = field(default_factory=list)

    def row(self, text: str) -> list[int]:
        """Indices of the features in a text."""
        known = self.vocabulary
        return sorted({known[f] for f in features(text) if f in known})

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """(rows x categories), each category fed with the ones before."""
        n = len(self.vocabulary)
        out = np.zeros((len(rows), len(self.models)))
        for k, model in enumerate(self.models):
            word, before = model.weights[:n], model.weights[n:]
            z = np.array([word[r].sum() if r else 0.0 for r in rows]) + model.constant
            if k:
                z = z + out[:, :k] @ before
            out[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_linear(
    x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None, ridge: float = 1.0, steps: int = 50
) -> Linear:
    """Ridge logistic regression of weighted rows by Newton steps, halved until the loss falls."""
    v = np.ones(len(y)) if weights is None else weights
    rate = ((v * y).sum() + 0.5) / (v.sum() + 1)
    if not 0 < y.sum() < len(y):
        rate = 1e-6 if not y.any() else 1 - 1e-6
        return Linear(np.zeros(x.shape[1]), float(np.log(rate / (1 - rate))))
    full = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(full.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = full @ w
        return float((v * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (v * (p - y)) + penalty * w
        hessian = (full * (v * p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        if now - new < 1e-6 * abs(now):
            break
        w, now = w - size * step, new
    return Linear(w[:-1], float(w[-1]))


def fit_chain(
    x: np.ndarray, labels: dict[str, np.ndarray], folds: np.ndarray, weights: np.ndarray | None = None
) -> list[Linear]:
    """One model per category, in order; earlier categories enter by out-of-fold probabilities.

    Rows whose label is NaN are left out of that category's fits and only get its probabilities.
    """
    models = []
    v = np.ones(len(x)) if weights is None else weights
    for y in labels.values():
        held = np.zeros(len(y))
        given = ~np.isnan(y)
        for k in range(int(folds.max(initial=-1)) + 1):
            out = folds == k
            if out.any():
                rest = ~out & given
                held[out] = fit_linear(x[rest], y[rest], v[rest]).probability(x[out])
        models.append(fit_linear(x[given], y[given], v[given]))
        x = np.hstack([x, held[:, None]])
    return models


def _labelled(documents: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """(id, y, h): every labelled id that has a document, its label and a hash."""
    known = (
        labels.where(F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isNotNull())
        .groupBy(F.col(f"`{doc_id}`").alias("id"))
        .agg((F.max(F.col(f"`{label}`").cast("double")) > 0).cast("int").alias("y"))
        .withColumn("h", F.xxhash64("id"))
    )
    # a labelled id without a document must not use up the bound
    return known.join(documents.select(F.col(f"`{doc_id}`").alias("id")).distinct(), "id", "left_semi")


def _sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample_docs: int) -> DataFrame:
    """(id, text, label, fold) of the bounded sample, written out."""
    known = _labelled(documents, labels, doc_id, label)
    part = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy("h", "id").limit(sample_docs)
        part = some if part is None else part.unionByName(some)
    part = materialised(part, "toxicity-ids")
    body = documents.select(F.col(f"`{doc_id}`").alias("id"), text_of(f"`{text}`").alias("t"))
    # bounded by 2 * sample_docs ids
    sample = body.join(F.broadcast(part), "id").select(
        "id", "t", "y", F.pmod(F.shiftright("h", 7), F.lit(FOLDS)).cast("int").alias("fold")
    )
    schema = T.StructType([*sample.schema.fields, *[T.StructField(f"k{i}", T.LongType()) for i in range(THINNING)]])
    sample = materialised(sample.mapInArrow(_keyed, schema), "toxicity-sample")
    for key in ("id", *[f"k{i}" for i in range(THINNING)]):
        first = Window.partitionBy("y", key).orderBy("id", "t")
        sample = sample.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return materialised(sample.select("id", "t", "y", "fold"), "toxicity-sample")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the smallest hashes of the three-word shingles of column t."""
    for batch in batches:
        keys = [[] for _ in range(THINNING)]
        for t in batch.column(1).to_pylist():
            words = WORDS.findall(t.lower())
            runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
            for seed, own in enumerate(keys):
                own.append(min(xxhash.xxh3_64_intdigest(r, seed) for r in runs) >> 1)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *[pa.array(k, pa.int64()) for k in keys]],
            [*batch.schema.names, *[f"k{i}" for i in range(THINNING)]],
        )


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, ys = [], []
        for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = features(t)
            names += found
            ys += [y] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32())], ["f", "y"])


def fit(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    seeds: dict[str, tuple[str, ...]] = SEEDS,
    sample_docs: int = SAMPLE_DOCS,
    max_features: int = MAX_FEATURES,
    min_docs: int = 5,
) -> Chain:
    """A chain fitted on the bounded sample. The driver gets at most 2 * sample_docs rows of feature indices."""
    sample = _sample(documents, labels, doc_id, text, label, sample_docs)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    known = _labelled(documents, labels, doc_id, label).groupBy("y").agg(F.count("*").alias("n")).collect()
    # labelled documents that a sample row stands for; the label with fewer of them weighs 1
    stands = {r["y"]: r["n"] / sizes[r["y"]] for r in known if r["y"] in sizes}
    weight_of = {y: v / min(stands.values()) for y, v in stands.items()}
    counts = sample.select("t", "y").mapInArrow(_exploded, "f string, y int").groupBy("f").agg(
        F.count_if(F.col("y") == 1).alias("c1"), F.count_if(F.col("y") == 0).alias("c0")
    )
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1), (F.col("c0") + 0.5) / (n0 + 1)
    weight = F.log(p1 / p0) / F.sqrt(1 / (F.col("c1") + 0.5) + 1 / (F.col("c0") + 0.5))
    top = (
        counts.where((F.col("c1") >= min_docs) & (p1 >= 5 * p0))
        .orderBy(weight.desc(), "f")
        .limit(max_features)
        .collect()
    )
    chain = Chain(vocabulary={r["f"]: i for i, r in enumerate(sorted(top, key=lambda r: r["f"]))})
    seed_sets = {name: frozenset(words) for name, words in seeds.items()}
    vocabulary = chain.vocabulary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([sorted(vocabulary[f] for f in t if f in vocabulary) for t in texts], pa.list_(pa.int32())),
                    pa.array([[int(bool(t & s)) for s in seed_sets.values()] for t in texts], pa.list_(pa.int32())),
                    batch.column(1),
                    batch.column(2),
                ],
                ["x", "seeds", "y", "fold"],
            )

    got = sample.select("t", "y", "fold").mapInArrow(rows, "x array<int>, seeds array<int>, y int, fold int").collect()
    x = np.zeros((len(got), len(vocabulary)))
    for i, r in enumerate(got):
        x[i, r["x"]] = 1
    y = np.array([r["y"] for r in got], float)
    holds = np.array([r["seeds"] for r in got], float).reshape(len(got), len(seed_sets))
    unknown = (y == 1) & ~holds.any(axis=1)
    targets = {name: np.where(unknown, np.nan, y * holds[:, k]) for k, name in enumerate(seed_sets)}
    targets[label] = y
    folds = np.array([r["fold"] for r in got], int)
    chain.names = list(targets)
    chain.models = fit_chain(x, targets, folds, np.array([weight_of[r["y"]] for r in got], float)) if len(got) else [Linear(np.zeros(k), -13.8) for k in range(len(targets))]
    return chain


def scored(df: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add p_<category> for every category and the boolean of the last one.

    Input columns of these names are replaced; all others pass through.
    """
    probabilities = [f"p_{n}" for n in chain.names]
    verdict = chain.names[-1]
    new = {n.lower() for n in [*probabilities, verdict]}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new or c == text])
    schema = T.StructType(df.schema.fields + [T.StructField(f"__{p}", T.DoubleType()) for p in probabilities])
    # bounded: max_features x categories
    shared = df.sparkSession.sparkContext.broadcast(
        (chain.vocabulary, chain.names, [(m.weights, m.constant) for m in chain.models])
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, categories, weights = shared.value
        model = Chain(vocabulary, categories, [Linear(*w) for w in weights])
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            p = model.probabilities([model.row(t) for t in batch.column(at).to_pylist()])
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                batch.select(names).columns + [pa.array(p[:, k]) for k in range(len(probabilities))], schema.names
            )

    out = df.withColumn("__text", text_of(f"`{text}`")).mapInArrow(score, schema)
    added = {p: F.col(f"__{p}") for p in probabilities} | {verdict: F.col(f"__{probabilities[-1]}") >= threshold}
    return with_columns(out, **added).drop(*[f"__{p}" for p in probabilities])
