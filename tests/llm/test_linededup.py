import brute
import numpy as np
import pyarrow as pa
import pytest

from emberlake.llm import linededup
from emberlake.llm.common import pieces


def test_perfect_hash_is_minimal_and_survives_writing():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 5000):
        h1, h2 = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
        mph = linededup.PerfectHash.load(*linededup.PerfectHash.build(h1, h2).dump())
        assert sorted(mph.index(h1, h2)) == list(range(n))


def test_keys_left_after_the_last_level(monkeypatch):
    monkeypatch.setattr(linededup, "MAX_LEVELS", 1)
    h = np.arange(300, dtype=np.uint64)
    mph = linededup.PerfectHash.load(*linededup.PerfectHash.build(h, h + np.uint64(1)).dump())
    assert len(mph.rest) and sorted(mph.index(h, h + np.uint64(1))) == list(range(300))


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 2, "shard_probes": 3}])
def test_documents(odd_docs, odd_texts, sizes):
    want = brute.line_dedup(odd_texts, min_docs=4)
    got = linededup.deduplicated(odd_docs, min_docs=4, **sizes).collect()
    assert len(got) == len(odd_texts)
    found = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["text"]) for r in got)
    assert found == sorted((i or 0, *want[i, t]) for i, t in odd_texts)
    assert sum(r["n_dropped"] for r in got) > 0


def test_columns_and_empty_table(odd_docs, no_docs):
    got = linededup.deduplicated(odd_docs)
    assert set(got.columns) == set(odd_docs.columns) | {"n_dropped"} and dict(got.dtypes)["n_lines"] == "bigint"
    assert linededup.deduplicated(no_docs).count() == 0


def test_string_ids(spark):
    text = "one line that is long enough to count as a real line"
    df = spark.createDataFrame([(f"d{i}", text) for i in range(6)], "doc_id string, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in linededup.deduplicated(df).collect()}
    assert got == {f"d{i}": int(i < 5) for i in range(6)}


def test_texts_are_handled_in_bounded_pieces():
    texts = ["a" * 10, None, "é" * 10, "", "b" * 70, "c", "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["i", "t"]).slice(1)
    got = list(pieces(iter([batch, batch.slice(0, 0)]), "t", 30))
    assert [p.column("i").to_pylist() for p in got] == [[1, 2, 3], [4], [5, 6]]
    assert [x for p in got for x in p.column("t").to_pylist()] == texts[1:]


def test_a_text_travels_once(spark):
    df = spark.createDataFrame([(1, "x\ny", 3)], "doc_id long, text string, n_chars long")
    plan = linededup.deduplicated(df)._jdf.queryExecution().optimizedPlan().toString()
    rewrite = next(line for line in plan.splitlines() if "MapInArrow rewrite" in line)
    sent = rewrite[rewrite.index("(") + 1 : rewrite.index(")")].split(", ")
    assert [name.split("#")[0] for name in sent] == ["doc_id", "n_chars", "text", "__lost"]
