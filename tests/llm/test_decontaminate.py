import random

import brute
import pytest

from emberlake.llm import decontaminate as dc

ITEM = "Which of the seven northern rivers carries the greatest volume of water in an average spring season, and why is that so"


def damaged(text, edits, seed):
    rng, out = random.Random(seed), list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [out[at], rng.choice("xyz")]])
    return "".join(out)


def test_distance_equals_dynamic_programming():
    rng = random.Random(2)
    for k in range(150):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60))) + damaged(item, rng.randint(0, 4), k)
        got = dc.Myers(item).best(text, len(item))
        want = brute.best_distance(item, text)
        assert (got[0] if got else len(item)) == want or (got is None and want >= len(item))


def test_every_match_within_budget_is_found():
    item = dc.normal(ITEM)
    errors = dc.budget(len(item))
    matcher = dc.Matcher([(7, item)], dc.ERROR_RATE, dc.MIN_PIECE)
    for seed in range(200):
        text = "some words before it " + damaged(item, seed % (2 * errors), seed) + " and some after"
        want = brute.best_distance(item, text)
        found = matcher.find(text)
        assert bool(found) == (want <= errors)
        if found:
            assert found[0][1] == want and brute.best_distance(item, text[found[0][2] : found[0][3]]) == want


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "too short"), (6, "Another passage that nobody has ever copied from the test set")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_documents(spark, odd_docs, no_docs, benchmark):
    leak = spark.createDataFrame(
        [(100, f"intro\n{ITEM.upper()}\t\nend"), (101, ITEM[:60]), (102, damaged(ITEM, 2, 1)), (102, damaged(ITEM, 2, 1))],
        "doc_id long, text string",
    )
    docs = odd_docs.unionByName(leak, allowMissingColumns=True)
    for block in (10, 10_000):
        rows = dc.matches(docs, benchmark, block_chars=block).collect()
        assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(100, 1), (100, 2)] + [(102, 1)] * 2 + [(102, 2)] * 2
    clean = dc.clean_rows(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == odd_docs.count() + 1
    assert dc.matches(no_docs, benchmark).count() == 0
    assert dc.matches(docs, benchmark.where("false")).count() == 0
    assert dc.clean_rows(docs, benchmark.where("false")).count() == docs.count()


def test_short_items_are_found_on_word_boundaries(spark):
    items = [(1, "What is Ohm's law?"), (2, "2 + 2"), (3, "art"), (4, "水は何度で凍る"), (5, " \t"), (6, None), (7, "art")]
    texts = [
        (1, "Quiz: what is  OHM'S law? Answer below"), (2, "so 2 + 2 is four"), (3, "12 + 2 and 2 + 23"), (4, "a party starts"),
        (5, "party art"), (6, "では水は何度で凍るか"), (7, None), (8, "What is Ohms law?"), (9, "(art)"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (3, 10_000):
        rows = dc.matches(docs, benchmark, block_chars=block).collect()
        got = sorted((r["doc_id"], r["item_id"], r["distance"], r["start"], r["end"]) for r in rows)
        assert got == [
            (1, 1, 0, 6, 24), (2, 2, 0, 3, 8), (5, 3, 0, 6, 9), (5, 7, 0, 6, 9), (6, 4, 0, 2, 9), (9, 3, 0, 1, 4), (9, 7, 0, 1, 4)
        ]
    assert sorted(r["doc_id"] for r in dc.clean_rows(docs, benchmark).collect()) == [3, 4, 7, 8]
    assert dc.matches(docs, benchmark, min_chars=24).count() == 0
