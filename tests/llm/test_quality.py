import brute
import pytest
from pyspark.sql import functions as F

from emberlake.llm import quality

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_equal_plain_python(odd_docs):
    rows = quality.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = brute.quality(r["text"])
        assert {n: r[n] for n in NAMES} == want
        assert not (r["base_failed"] and r["kept"])


def test_clashing_names_are_replaced_and_others_pass(odd_docs):
    got = quality.judged(odd_docs)
    assert dict(got.dtypes)["n_words"] == "bigint" and dict(got.dtypes)["kept"] == "boolean"
    assert "lang" in got.columns and got.columns.count("kept") == 1


def test_kept_rows_keep_their_columns(odd_docs, no_docs):
    prose = F.lit(" ".join(f"the word{i} of a tale{i}" for i in range(30)))
    docs = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumn("text", prose))
    kept = quality.kept_rows(docs)
    assert kept.columns == odd_docs.columns
    assert [r["kept"] for r in kept.collect()] == ["k"]
    assert quality.judged(no_docs).count() == 0


@pytest.mark.parametrize(
    "text, kept",
    [
        (" ".join(f"the word{i} of a tale{i}" for i in range(30)), True),
        (" ".join(f"the word{i}### of a tale{i}***" for i in range(30)), False),
        (" ".join(f"THE!! WORD{i}!! OF!!" for i in range(30)), False),
        (" ".join(f"zq{i} xk{i} vj{i}" for i in range(30)), False),
    ],
)
def test_threshold_table(spark, text, kept):
    assert quality.judged(spark.createDataFrame([(text,)], "text string")).first()["kept"] is kept


def test_rules_are_data(spark):
    df = quality.measured(spark.createDataFrame([("one two three",)], "text string"))
    strict = [quality.Rule("few", "n_words", None, 2)]
    assert df.select(quality.compiled(strict)).first()[0] is False
    assert df.select(quality.compiled([])).first()[0] is True


def test_no_python_in_the_plan(odd_docs):
    plan = quality.judged(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan
