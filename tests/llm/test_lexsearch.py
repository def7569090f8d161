import math
import random
import re

from emberlake.llm import lexsearch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, limit=10):
    """(item id, rank, doc id, score) in order of the items."""
    bodies = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    bodies = [(i, ts) for i, ts in bodies if ts]
    n, total = len(bodies), sum(len(ts) for _, ts in bodies)
    out = []
    for item, text in items:
        scores = []
        for i, ts in bodies:
            m = 10 + (90 * len(ts) * n) // total
            s = 0
            for t in set(TERM.findall((text or "").translate(LOWER))):
                df = sum(1 for _, other in bodies if t in other)
                if df:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                    s += w * (1_000_000_000 * ts.count(t) // (1000 * ts.count(t) + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(scores)[:limit], 1)]
    return out


def order(rows):
    return sorted(rows, key=str)


def ranked(spark, docs, items, parts=3, **options):
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, rank string, score int")
    b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, doc_id string")
    return [tuple(r) for r in lexsearch.ranked(d.repartition(parts), b, **options).collect()]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{c}{k}" for c in "aBcDé漢" for k in range(12)] + ["The", "the", "of"] * 20
    docs = [(i, rng.choice([" ", "-", "\n", "\x1c"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    return docs, [(100 + k, " ".join(rng.choices(words, k=rng.randint(1, 8)))) for k in range(15)]


def test_like_brute_force(spark):
    docs, items = corpus(1, 200)
    want = order(brute(docs, items))
    assert order(ranked(spark, docs, items)) == want
    # many blocks of items, many partitions
    assert order(ranked(spark, docs, items, parts=11, block_chars=40)) == want


def test_copies_and_ties(spark):
    docs, items = corpus(2, 60)
    docs += [(1000 + k, docs[0][1]) for k in range(40)] + [(0, docs[0][1])]
    assert order(ranked(spark, docs, items, limit=4)) == order(brute(docs, items, 4))


def test_odd_tables(spark, odd_texts):
    items = [
        (1, "quick brown fox"), (1, "Quick BROWN fox"), (2, None), (3, ""), (4, "-- ??"), (None, "漢字 ß"), (5, "nowhere"),
        (6, "the word5 and"), (7, "Done!"),
    ]
    got = ranked(spark, odd_texts, items)
    assert order(got) == order(brute(odd_texts, items))
    assert {r[0] for r in got} == {1, 6, 7, None}
    assert ranked(spark, [], items) == [] and ranked(spark, odd_texts, []) == []
    assert ranked(spark, [(1, None), (2, " ")], items) == []


def test_ids_past_the_last_long_are_not_mixed_with_missing_ones(spark):
    got = ranked(spark, [(None, "one"), (None, "one"), (5, "one"), (6, "two"), (7, "two"), (8, "two"), (9, "two")], [(1, "one")])
    assert [r[2] for r in got] == [5, None, None]
