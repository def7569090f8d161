"""Column expressions on boundary values and captured shapes."""

import math
import random

import pytest
from helpers import distance, geom_value, metres, point, polygon, square
from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.functions import geometry, projection, severity, values
from emberlake.operators import rings


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def column_of(spark, rows, schema, column):
    return [r["v"] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def shapes(spark, geoms):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("geom", schemas.GEOMETRY)])
    return spark.createDataFrame(list(enumerate(geoms)), schema)


def test_fire_severity_steps(spark):
    rows = [("burnt_area", a) for a in (None, 30.0, 499.9, 500.0, 4999.0, 5000.0)] + [("hotspot", 99999.0)]
    got = column_of(spark, rows, "k string, a double", severity.wildfire_severity(F.col("k"), F.col("a")))
    assert got == [2, 2, 2, 3, 3, 4, 2]


def test_unknown_kind_and_level_fail(spark):
    for bad in (
        severity.wildfire_severity(F.lit("volcano"), F.lit(1.0)),
        severity.warning_severity(F.lit("morado")),
    ):
        with pytest.raises(Exception, match="unknown"):
            one(spark, bad)


def test_quake_and_warning_severity(spark):
    rows = [(m,) for m in (1.5, 2.9, 3.0, 3.9, 4.0, 5.4, 5.5, 7.0)]
    got = column_of(spark, rows, "m double", severity.quake_severity(F.col("m")))
    assert got == [1, 1, 2, 2, 3, 3, 4, 4]
    rows = [(n,) for n in ("verde", "amarillo", "naranja", "rojo", " Naranja ")]
    assert column_of(spark, rows, "n string", severity.warning_severity(F.col("n"))) == [1, 2, 3, 4, 3]


def test_content_hash_ignores_argument_order_and_sees_changes(spark):
    a = one(spark, values.content_hash(a=F.lit(1), b=F.lit("x")))
    assert a == one(spark, values.content_hash(b=F.lit("x"), a=F.lit(1)))
    assert a != one(spark, values.content_hash(a=F.lit(2), b=F.lit("x")))
    assert len(a) == 64


def test_projection_known_place_and_round_trip(spark):
    p = one(spark, projection.to_metres(F.lit(-3.70), F.lit(40.42)))
    assert abs(p["x"] - 440615.66) < 0.02 and abs(p["y"] - 4474610.02) < 0.02
    assert one(spark, projection.to_metres(F.lit(-3.0), F.lit(41.0)))["x"] == 500000.0
    rnd = random.Random(5)
    for _ in range(200):
        lon, lat = rnd.uniform(-18, 5), rnd.uniform(27, 44)
        back = projection.inverse(math, *projection.forward(math, lon, lat))
        assert abs(back[0] - lon) < 1e-8 and abs(back[1] - lat) < 1e-8


def test_ring_projection_equals_point_projection(spark):
    g = polygon((-3.7, 40.4), (-3.6, 40.4), (-3.6, 40.5))
    ring = shapes(spark, [g]).select(projection.ring_to_metres(F.col("geom")["parts"][0][0]).alias("r")).first()["r"]
    for v, want in zip(ring, g[1][0][0]):
        assert math.dist((v["x"], v["y"]), metres(*want)) < 1e-6


def test_circle_bounds_hold_the_circle():
    rnd = random.Random(3)
    for _ in range(40):
        lon, lat, r = rnd.uniform(-9, 4), rnd.uniform(36, 44), rnd.choice([50, 5_000, 200_000])
        box = projection.circle_bounds(lon, lat, r)
        cx, cy = metres(lon, lat)
        for i in range(90):
            a = math.radians(4 * i)
            x, y = projection.inverse(math, cx + r * math.cos(a), cy + r * math.sin(a))
            assert box[0] <= x <= box[2] and box[1] <= y <= box[3]


def test_times(spark):
    got = spark.range(1).select(
        *[
            values.madrid_to_utc(F.lit(t)).cast("string").alias(f"c{i}")
            for i, t in enumerate(
                ("02/07/2026 7:06:37", "15/01/2026 12:00:00", "32/01/2026 12:00:00", "29/03/2026 2:30:00")
            )
        ],
        values.iso_moment(F.lit("2026-07-03T13:00:00+02:00")).cast("string").alias("iso"),
        values.iso_moment(F.lit("2026-07-02T16:28:03-00:00")).cast("string").alias("zero"),
        values.utc_moment(F.lit("2026-07-02 12:06:00")).cast("string").alias("plain"),
        values.utc_moment(F.lit("yesterday")).cast("string").alias("bad"),
    ).first()
    assert got["c0"] == "2026-07-02 05:06:37" and got["c1"] == "2026-01-15 11:00:00"
    assert got["c2"] is None and got["c3"] == "2026-03-29 01:30:00"
    assert got["iso"] == "2026-07-03 11:00:00" and got["zero"] == "2026-07-02 16:28:03"
    assert got["plain"] == "2026-07-02 12:06:00" and got["bad"] is None


def test_latlon_polygon(spark):
    rows = [("41.0,-2.0 41.5,-2.25 41.75,-1.5 41.0,-2.0",), ("41.0,-2.0 41.5 41.75,-1.5 41.2,-2.1",),
            ("1,2 3,4 5,6",), ("a,b c,d e,f g,h",)]
    got = column_of(spark, rows, "t string", geometry.latlon_polygon(F.col("t")))
    assert [g is None for g in got] == [False, True, True, True]
    assert tuple(got[0]["parts"][0][0][0]) == (-2.0, 41.0)
    assert (got[0]["minx"], got[0]["maxy"]) == (-2.25, 41.75)


def test_geojson_round_trip(spark):
    texts = [
        '{"type":"Point","coordinates":[-3.5,40.25]}',
        '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}',
        '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]],[[[5.0,5.0],[6.0,5.0],[6.0,6.0],[5.0,5.0]]]]}',
    ]
    got = column_of(spark, [(t,) for t in texts], "t string", geometry.to_geojson(geometry.from_geojson(F.col("t"))))
    assert got == texts
    empty = column_of(spark, [('{"type":"Polygon","coordinates":[]}',)], "t string", geometry.from_geojson(F.col("t")))
    assert empty == [None]


def test_within_excludes_the_boundary_and_holes(spark):
    hole = geom_value(
        "Polygon",
        [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)],
          [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]]],
    )
    spots = [(0.5, 0.5), (1.5, 1.5), (0.0, 2.0), (4.0, 4.0), (5.0, 1.0), (1.0, 1.5), (3.0, 1.0)]
    df = shapes(spark, [hole]).select(
        *[geometry.strictly_inside(geometry.edges(F.col("geom")), F.lit(x), F.lit(y)).alias(f"c{i}")
          for i, (x, y) in enumerate(spots)]
    )
    assert list(df.first()) == [True, False, False, False, False, False, True]


def test_centroid_of_hole_and_two_parts(spark):
    two = geom_value("MultiPolygon", [square(0, 0, 1)[1][0], square(10, 0, 2)[1][0]])
    got = shapes(spark, [two, point(3, 4)]).orderBy("n").select(geometry.centroid(F.col("geom")).alias("c")).collect()
    assert abs(got[0]["c"]["x"] - 8.0) < 1e-12 and abs(got[0]["c"]["y"]) < 1e-12
    assert tuple(got[1]["c"]) == (3.0, 4.0)


def test_box_intersection_is_exact(spark):
    slanted = polygon((0, 0), (10, 10), (9, 10), (-1, 0))
    boxes = {(8.0, 1.0, 9.0, 2.0): False, (4.0, 4.0, 6.0, 6.0): True, (-50.0, -50.0, 50.0, 50.0): True,
             (4.6, 4.9, 4.8, 5.1): True, (10.0, 10.0, 11.0, 11.0): True}
    for box, want in boxes.items():
        got = shapes(spark, [slanted]).select(geometry.intersects_box(F.col("geom"), box).alias("v")).first()["v"]
        assert got is want, box


def test_shape_distances_agree_with_brute_force(spark):
    rnd = random.Random(11)
    geoms = [square(-3.7 + rnd.random() * 0.2, 40.3 + rnd.random() * 0.2, rnd.choice([0.005, 0.02])) for _ in range(9)]
    df = shapes(spark, geoms).select("n", geometry.edges_of_parts(geometry.metric_parts(F.col("geom"))).alias("e"))
    pairs = df.alias("a").join(df.alias("b"), F.col("a.n") < F.col("b.n"))
    got = pairs.select(
        F.col("a.n").alias("i"), F.col("b.n").alias("j"),
        geometry.shapes_distance(F.col("a.e"), F.col("b.e")).alias("d"),
    ).collect()
    assert len(got) == 36
    for r in got:
        assert abs(r["d"] - distance(geoms[r["i"]], geoms[r["j"]])) < 1e-6


def test_coordinates_ok(spark):
    rows = [([(1.0, 2.0)],), ([(float("nan"), 2.0)],), ([(1.0, float("inf"))],), ([(1.0, 90.5)],), ([],), (None,),
            ([(1.0, 2.0), (-181.0, 0.0)],), ([(180.0, -90.0)],)]
    got = column_of(spark, rows, "v array<struct<x:double,y:double>>", geometry.coordinates_ok(F.col("v")))
    assert got == [True, False, False, False, False, False, False, True]


def _ring(*pts):
    return [(float(x), float(y)) for x, y in (*pts, pts[0])]


@pytest.mark.parametrize("short", [24, 0])
def test_audit_rings(spark, monkeypatch, short):
    monkeypatch.setattr(rings, "SHORT_RING", short)
    star = [(math.cos(math.radians(90 + 144 * i)), math.sin(math.radians(90 + 144 * i))) for i in range(5)]
    rows = [
        ("square", _ring((0, 0), (2, 0), (2, 2), (0, 2))),
        ("bow", _ring((0, 0), (2, 2), (2, 0), (0, 2))),
        ("flat", _ring((0, 0), (1, 1), (2, 2))),
        ("star", _ring(*star)),
        ("repeat", _ring((0, 0), (2, 0), (2, 0), (2, 2), (0, 2))),
    ]
    df = spark.createDataFrame(rows, "key string, ring array<struct<x:double,y:double>>")
    got = {r["key"]: r for r in rings.audit_rings(df).collect()}
    assert [got[k]["crossing"] for k, _ in rows] == [False, True, True, True, False]
    assert got["square"]["area"] == 4.0 and (got["square"]["x"], got["square"]["y"]) == (1.0, 1.0)
    assert abs(got["bow"]["area"] - 2.0) < 1e-12 and abs(got["bow"]["x"] - 1.0) < 1e-12
    assert got["star"]["crossings"] == 5
    assert got["flat"]["empty"] and not got["bow"]["empty"]
    # Even-odd area of a pentagram with unit radius: its five tips without the pentagon inside.
    inner, half = (3 - math.sqrt(5)) / 2, math.radians(36)
    tips = 5 * inner * math.sin(half) * (1 - inner * math.cos(half))
    assert abs(got["star"]["area"] - tips) < 1e-9


def test_long_ring_crossing_is_found_once(spark):
    n = 400
    wave = [(i, math.sin(i / 7) * 3 + 10) for i in range(n)]
    back = [(i, -10 + (30 if i == 200 else 0)) for i in reversed(range(n))]
    df = spark.createDataFrame([("w", _ring(*wave, *back))], "key string, ring array<struct<x:double,y:double>>")
    row = rings.audit_rings(df).first()
    assert row["crossings"] == 2 and row["area"] > 0


def test_long_rings_are_not_broadcast(spark):
    """The planner takes segments filed by cell for a small table, however many they are."""
    corners = [(i, i % 2) for i in range(20)] + [(i, 1 - i % 2) for i in reversed(range(20))]
    ring = [{"x": float(x), "y": float(y)} for x, y in [*corners, corners[0]]]
    df = spark.createDataFrame([("a", ring), ("b", ring)], "key string, ring array<struct<x: double, y: double>>")
    found = rings.audit_rings(df)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["key"], r["crossings"], r["area"]) for r in found.orderBy("key").collect()] == [
        ("a", 19, pytest.approx(9.5)), ("b", 19, pytest.approx(9.5))
    ]


def test_metres_name_each_stage_once(spark):
    df = spark.createDataFrame([(-3.70, 40.42), (-9.1, 36.2), (None, 40.0)], "lon double, lat double")
    made = df.select("lon", "lat", projection.to_metres(F.col("lon"), F.col("lat")).alias("m"))
    for r in made.collect():
        if r["lon"] is None:
            assert r["m"]["x"] is None
        else:
            x, y = projection.forward(math, r["lon"], r["lat"])
            assert abs(r["m"]["x"] - x) < 1e-6 and abs(r["m"]["y"] - y) < 1e-6
    assert made._jdf.queryExecution().analyzed().toString().lower().count("atanh(") <= 3
