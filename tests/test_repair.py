"""Untangling of rings against counting crossings."""

import json
import math
import random

import pytest
from helpers import polygon, square
from pyspark.sql import functions as F
from test_feeds import cap, documents, info

from emberlake import schemas
from emberlake.functions import geometry
from emberlake.operators import repair, spatial_join
from emberlake.sources import feeds


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
                odd = not odd
    return odd


def closed(*corners):
    return [*corners, corners[0]]


def total(parts):
    return sum(abs(repair._area(r)) * (1 if k == 0 else -1) for part in parts for k, r in enumerate(part))


STAR = closed(*[(math.cos(math.radians(90 + 144 * k)), math.sin(math.radians(90 + 144 * k))) for k in range(5)])


@pytest.mark.parametrize(
    ("ring", "lobes", "area"),
    [
        (closed((0, 0), (1, 0), (1, 1), (0, 1)), 1, 1.0),
        (closed((0, 0), (1, 1), (1, 0), (0, 1)), 2, 0.5),
        (closed((0, 0), (100, 0), (20, 100), (80, 100)), 2, 4250.0),
        (closed((0, 0), (2, 0), (2, 2), (1, 0), (0, 2)), 2, 2.0),  # touches its own side
        (closed((0, 0), (4, 0), (4, 0), (4, 4), (0, 4)), 1, 16.0),  # repeated corner
        (closed((0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4)), 1, 16.0),  # spike
        (closed((0, 0), (4, 0), (4, 4), (0, 4), (0, 0), (1, 1), (1, 2), (2, 2), (2, 1), (1, 1)), 1, 15.0),  # hole by a seam
    ],
)
def test_known_rings(ring, lobes, area):
    parts = repair.untangled(ring)
    assert len(parts) == lobes and total(parts) == pytest.approx(area)


def test_a_star_keeps_its_tips_only():
    parts = repair.untangled(STAR)
    assert len(parts) == 5 and not inside([r for p in parts for r in p], 0, 0)


@pytest.mark.parametrize("ring", [closed((0, 0), (1, 1), (0.5, 0.5)), closed((0, 0), (2, 0), (2, 0), (0, 0)), closed((1, 1), (1, 1), (1, 1))])
def test_flat_rings_bound_nothing(ring):
    assert repair.untangled(ring) is None


def test_random_rings_keep_their_region():
    rnd = random.Random(5)
    for _ in range(150):
        n = rnd.randint(4, 14)
        corner = (lambda: rnd.randint(0, 6)) if rnd.random() < 0.4 else (lambda: rnd.uniform(0, 6))
        ring = closed(*[(corner(), corner()) for _ in range(n)])
        parts = repair.untangled(ring) or []
        rings = [r for part in parts for r in part]
        spots = [(rnd.uniform(-0.5, 6.5), rnd.uniform(-0.5, 6.5)) for _ in range(60)]
        assert [inside(rings, *s) for s in spots] == [inside([ring], *s) for s in spots]
        # no two sides cross, and holes take away what outer rings hold
        for part in parts:
            # a ring that needs no repair keeps its direction
            assert parts == [[[(float(x), float(y)) for x, y in ring]]] or repair._area(part[0]) > 0 and all(repair._area(h) < 0 for h in part[1:])
        sides = [(a, b) for r in rings for a, b in zip(r, r[1:])]
        for i, (a, b) in enumerate(sides):
            for c, d in sides[i + 1 :]:
                if not {a, b} & {c, d}:
                    turns = [turn(a, b, c) * turn(a, b, d), turn(c, d, a) * turn(c, d, b)]
                    assert max(turns) > -1e-9, (ring, a, b, c, d)


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def test_in_query_test_sends_every_crossing_ring_on(spark):
    rnd = random.Random(6)
    rings = [closed(*[(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(rnd.randint(3, 9))]) for _ in range(200)]
    rows = [(i, [(float(x), float(y)) for x, y in r]) for i, r in enumerate(rings)]
    df = spark.createDataFrame(rows, "i int, ring " + schemas.RING.simpleString())
    look = {r["i"]: r["m"] for r in df.select("i", repair.may_cross(F.col("ring")).alias("m")).collect()}
    for i, r in rows:
        if not look[i]:
            assert repair.untangled(r) == [[r]]
    assert any(look.values()) and not all(look.values())


def lobed(corners, name):
    text = " ".join(f"{y},{x}" for x, y in corners)
    return cap(info("es-ES", name), name).replace("41.0,-2.0 41.5,-2.0 41.5,-1.5 41.0,-2.0", text)


def test_twisted_warning_is_placed_by_its_lobes(spark):
    """Equal lobes have no centre by the plain formula; a flat area is put aside."""
    texts = [
        lobed(closed((0, 0), (2, 0), (0, 2), (2, 2)), "twisted"),
        lobed(closed((0, 0), (1, 0), (0.2, 1), (0.8, 1)), "uneven"),
        lobed(closed((0, 0), (1, 1), (0.5, 0.5)), "flat"),
    ]
    good, _, _ = feeds.split_malformed(feeds.ingest_warnings(documents(spark, texts)))
    rows, aside = feeds.warning_events(good)
    got = {r["external_id"]: r for r in rows.select("external_id", "geom", geometry.centroid(F.col("geom")).alias("c")).collect()}
    assert set(got) == {"twisted", "uneven"} and [r["external_id"] for r in aside.collect()] == ["flat"]
    assert got["twisted"]["geom"]["kind"] == "MultiPolygon" and len(got["twisted"]["geom"]["parts"]) == 2
    assert (got["twisted"]["c"]["x"], got["twisted"]["c"]["y"]) == (pytest.approx(1), pytest.approx(1))
    assert got["uneven"]["c"]["y"] == pytest.approx(0.38480392)
    areas = spark.createDataFrame([("10", "A", square(1, 1, 0.4)), ("11", "B", polygon((0, 0), (1, 0), (1, 0.5), (0, 0.5)))], schemas.PROVINCES)
    events = rows.withColumn("id", F.col("external_id"))
    placed = {r["id"]: r["province_code"] for r in spatial_join.join_within(events, areas).collect()}
    assert placed == {"twisted": "10", "uneven": "11"}
    assert json.loads(rows.select(geometry.to_geojson(F.col("geom")).alias("g")).first()["g"])["type"] in ("Polygon", "MultiPolygon")
