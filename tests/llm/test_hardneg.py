import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlake.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string"


def brute(rows, every, positives=5, negatives=5, low=80):
    usable = []
    for i, x, y in rows:
        if i is None or y is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        usable.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in x], y))
    out = []
    for a, q, y in usable:
        if a % every:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, r)), i, z) for i, r, z in usable if i != a)
        for s, p, _ in [r for r in scored if r[2] == y][:positives]:
            window = [r for r in scored if r[2] != y and -low * s <= -100 * r[0] <= -100 * s]
            out += [(a, p, k, r[1], -s, -r[0]) for k, r in enumerate(window[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, parts=3, **options):
    df = spark.createDataFrame([(i, x, y, "s", "a") for i, x, y in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in hardneg.mined(df, F.col("id") % every == 0, **options).collect())


def vectors(seed, n, dims, sparse=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    x = centres[rng.integers(0, 4, n)] + rng.normal(size=(n, dims)) * 0.7
    if sparse:
        x *= rng.random((n, dims)) < 0.15
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return [(i, [float(c) for c in v], int(i * 7 % 3)) for i, v in enumerate(x)]


@pytest.mark.parametrize("sparse", [False, True])
def test_like_brute_force(spark, sparse):
    rows = vectors(5, 400, 24, sparse)
    want = brute(rows, 20)
    assert want and mined(spark, rows, 20) == want
    # several blocks of anchors and a sample that says little
    assert mined(spark, rows, 20, anchor_block=6, sample_rows=30) == want


def test_one_vector_shared_by_a_third(spark):
    rows = vectors(6, 300, 16)
    rows = [(i, rows[0][1] if i % 3 == 0 else x, y) for i, x, y in rows]
    want = brute(rows, 15)
    assert want and mined(spark, rows, 15, sample_rows=20) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [0.5, 0.5, 0.1]
    rows = [
        (0, x, 1), (0, x, 1), (1, x, 1), (1, x, 1), (2, None, 1), (3, [0.5, None, 1.0], 1), (4, [nan, 1.0, 0.0], 2),
        (5, [inf, 0.0, 0.0], 2), (6, x, None), (None, x, 1), (7, [], 2), (8, [0.5], 2), (9, [0.45, 0.5], 2), (10, x, 2),
        (11, x, 2), (20, [], 1), (30, [-0.5, -0.5], 2), (40, [0.0, 0.0, 0.0], 3), (50, [0.4, 0.6, 0.1, 0.2], 2),
    ]
    assert mined(spark, rows, 10) == brute(rows, 10)
    assert mined(spark, [], 10) == [] and mined(spark, [(1, x, 1)], 10) == []
    assert mined(spark, [(10, x, 1)], 10) == []
    assert mined(spark, [(10, [], 1), (11, [], 1), (12, [], 2)], 10) == brute([(10, [], 1), (11, [], 1), (12, [], 2)], 10)


def test_inexact_components_are_refused(spark):
    with pytest.raises(ValueError, match="exact"):
        mined(spark, [(0, [1e9, 1.0], 1), (1, [1e9, 1.0], 1)], 10)


def test_index_leaves_out_and_prunes_but_loses_nothing():
    rng = random.Random(7)
    for _ in range(40):
        n, dims = rng.randint(1, 60), rng.randint(1, 20)
        rows = np.array([[rng.randint(-9, 9) * (rng.random() < 0.5) for _ in range(dims)] for _ in range(n)], float)
        anchor = np.array([rng.randint(-9, 9) for _ in range(dims)], float)
        scores = rows @ anchor
        norm = np.linalg.norm(anchor)
        for threshold in (*np.quantile(scores, [0.1, 0.5, 0.9, 1.0]), -np.inf):
            unit = threshold / norm if norm else -np.inf
            found, got = hardneg.Index(rows, unit).reaching(anchor, threshold)
            assert sorted(found) == list(np.flatnonzero(scores >= threshold))
            assert list(got) == list(scores[found])
    index = hardneg.Index(np.array([[3.0, 0, 0, 4], [1, 1, 1, 1]]), 3.5)
    assert len(index.lists[0][1]) == 0 and sum(len(v) for _, v in index.lists) == 1
