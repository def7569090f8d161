"""The pipeline against a plain-Python version of every stage, each on the rows its predecessor kept."""

import brute
import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from emberlake.llm import decontaminate as dc
from emberlake.llm import quality, queries, tokencount

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def source(sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    return [(i, t) for i, t in rows if i in good]


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_one_by_one(spark, sf_dir, stages, source):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1])
    want = sorted(source)
    assert rows_of(stages[0]) == want
    want = sorted((i, kept) for (i, _), (_, _, kept) in brute.line_dedup(want).items())
    assert rows_of(stages[1]) == want
    groups, _ = brute.near_groups(want, 80)
    want = [(i, t) for i, t in want if groups[i] == i]
    assert rows_of(stages[2]) == want
    items = [dc.normal(t) for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    # an item within its budget has an untouched piece, so the others need no distance
    leaked = {
        i
        for i, t in want
        for item in items
        if any(p in dc.normal(t) for _, p in dc.pieces(item, dc.budget(len(item))))
        and brute.best_distance(item, dc.normal(t)) <= dc.budget(len(item))
    }
    assert leaked
    want = [(i, t) for i, t in want if i not in leaked]
    assert rows_of(stages[3]) == want
    ranks = tokencount.rank_table(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r["doc_id"], r["ids"], r["n_tokens"], r["decoded"]) for r in stages[4].collect())
    assert got == [(i, ids := library.encode_ordinary(t), len(ids), t) for i, t in want]


def test_run_equals_the_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(r["doc_id"] for r in stages[-1].collect())


def test_registered():
    assert "pipeline" in queries.QUERIES and len(queries.QUERIES) == 14
    assert all(any(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 14))


def test_empty_and_odd_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], docs.schema)
    for frame in (docs.where("false"), odd):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf_dir)
        assert frame.count() == 0
