import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import toxicity


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_accuracy(tables):
    documents, labels = tables
    training = labels.where("doc_id % 3 <> 0")
    chain = toxicity.fit(documents, training)
    held = documents.join(labels.where("doc_id % 3 = 0").withColumnRenamed("toxic", "truth"), "doc_id")
    rows = toxicity.scored(held, chain).select("toxic", "truth", "p_toxic", "p_insult").collect()
    caught = [r["toxic"] for r in rows if r["truth"]]
    false = [r["toxic"] for r in rows if not r["truth"]]
    # about an eighth of the positive labels are on texts without any toxic word
    assert len(caught) > 50 and np.mean(caught) > 0.8 and np.mean(false) < 0.005
    assert all(0 <= r["p_insult"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in rows)


def test_later_models_see_out_of_fold_probabilities(monkeypatch):
    seen = []
    original = toxicity.fit_linear

    def spy(x, y, *args):
        seen.append((x.copy(), y.copy()))
        return original(x, y, *args)

    monkeypatch.setattr(toxicity, "fit_linear", spy)
    rng = np.random.default_rng(0)
    x = (rng.random((60, 4)) < 0.5).astype(float)
    first, folds = x[:, 0] * (rng.random(60) < 0.8), np.arange(60) % 3
    models = toxicity.fit_chain(x, {"a": first, "b": x[:, 1]}, folds)
    assert [len(m.weights) for m in models] == [4, 5]
    fed = seen[-1][0][:, 4]
    for k in range(3):
        out = folds == k
        assert np.allclose(fed[out], original(x[~out], first[~out]).probability(x[out]))


def test_category_without_cases_is_constant():
    model = toxicity.fit_linear(np.ones((5, 2)), np.zeros(5))
    assert not model.weights.any() and model.probability(np.ones((1, 2)))[0] < 1e-3


def test_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(4, 0), (5, 0), (9, 0), (12, 1), (12, 0), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int"
    )
    chain = toxicity.fit(odd_docs, labels, min_docs=1)
    got = toxicity.scored(odd_docs, chain)
    assert got.count() == odd_docs.count() and dict(got.dtypes)["toxic"] == "boolean" and "lang" in got.columns
    for empty in (toxicity.fit(odd_docs, labels.where("false")), toxicity.fit(no_docs, labels)):
        assert not any(r["toxic"] for r in toxicity.scored(odd_docs, empty).collect())
    assert toxicity.scored(no_docs, chain).count() == 0


def test_sample_is_bounded_and_whole_texts_count(spark):
    rows = []
    for i in range(60):
        own = chr(97 + i // 26) + chr(97 + i % 26)
        rows.append((i, f"calm{own} words{own} only{own} here{own} " * 3 + ("grumpus " if i % 2 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, "doc_id", "text", "toxic", 10)
    assert sample.count() == 20
    copies = docs.withColumn("text", F.lit("the very same text of a toxic kind"))
    assert toxicity._sample(copies, labels, "doc_id", "text", "toxic", 10).count() == 2
    chain = toxicity.fit(docs, labels)
    late = spark.createDataFrame([(1, "pleasant prose " * 30_000 + "grumpus")], "doc_id long, text string")
    assert toxicity.scored(late, chain).first()["toxic"]


def test_probabilities_do_not_depend_on_the_sample(spark):
    """A word of every toxic and of a seventh of the clean documents is no verdict: most documents that hold it are clean."""
    rows, labels = [], []
    for i in range(2200):
        own = "".join(chr(97 + i // 26**k % 26) for k in range(3))
        toxic, holds = i % 11 == 0, i % 11 == 0 or i % 7 == 0
        rows.append((i, f"{own}calm {own}words {own}only {own}here " + ("grumpus " if holds else "") + f"{own}end {own}last"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    for bound in (150, 5_000):
        got = toxicity.scored(docs, toxicity.fit(docs, labels, sample_docs=bound)).select("toxic", "p_toxic").collect()
        assert not any(r["toxic"] for r in got)
        assert abs(np.mean([r["p_toxic"] for r in got]) - 1 / 11) < 0.03


def test_earlier_categories_in_other_languages(spark):
    """German seeds count, and toxic documents without a seed do not speak against a category."""
    rows, labels = [], []
    for i in range(240):
        own = "".join(chr(97 + i // 26**k % 26) for k in range(2))
        kind = i % 6
        # one toxic text in four holds a seed word
        word = "grumpus " * (kind < 2) + "vollidiot " * (kind < 2 and i % 12 < 6 and i // 12 % 2 == 0)
        rows.append((i, f"{own}und {own}der {own}ein {word}{own}ist {own}von {own}mit"))
        labels.append((i, int(kind < 2)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, "grumpus vollidiot"), (2, "grumpus"), (3, "calm")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(new, chain).collect()}
    # as negatives, the 60 toxic texts without a seed would teach that its companion alone means no insult
    assert got[1]["p_insult"] > 0.5 and got[2]["p_insult"] > 0.2 and got[3]["p_insult"] < 0.05
    assert got[1]["toxic"] and got[2]["toxic"] and not got[3]["toxic"]
