"""Planar geometry on ``struct<kind, parts, minx, miny, maxx, maxy>`` columns.

``parts[polygon][ring][vertex]`` with the outer ring first; a point is one vertex. Membership uses
the even-odd rule over all rings, which covers holes, several polygons and self-crossing rings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.functions import projection

# GeoJSON kinds.
POINT, POLYGON, MULTIPOLYGON = "Point", "Polygon", "MultiPolygon"

DBL_RING = "array<array<double>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def point(lon: Column, lat: Column) -> Column:
    x, y = lon.cast("double"), lat.cast("double")
    return F.struct(
        F.lit(POINT).alias("kind"),
        F.array(F.array(F.array(vertex(x, y)))).alias("parts"),
        x.alias("minx"),
        y.alias("miny"),
        x.alias("maxx"),
        y.alias("maxy"),
    )


def from_parts(kind: Column, parts: Column) -> Column:
    """Geometry with its bounding box; NULL when there is no vertex at all."""

    def shape(p):
        def boxed(flat):
            xs, ys = F.transform(flat, lambda v: v["x"]), F.transform(flat, lambda v: v["y"])
            return F.when(
                F.size(flat) > 0,
                F.struct(
                    kind.alias("kind"),
                    p.alias("parts"),
                    F.array_min(xs).alias("minx"),
                    F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"),
                    F.array_max(ys).alias("maxy"),
                ),
            )

        return let(F.flatten(F.flatten(p)), boxed)

    return let(parts, shape)


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def is_point(geom: Column) -> Column:
    return geom["kind"] == POINT


def _ring_edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, 1, n),
        F.slice(ring, 2, n),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def edges_of_parts(parts: Column) -> Column:
    return F.flatten(F.transform(F.flatten(parts), _ring_edges))


def edges(geom: Column) -> Column:
    """All ring segments; empty for a point."""
    return edges_of_parts(geom["parts"])


def on_some_edge(edge_array: Column, px: Column, py: Column) -> Column:
    return F.exists(
        edge_array,
        lambda e: ((e["x2"] - e["x1"]) * (py - e["y1"]) == (e["y2"] - e["y1"]) * (px - e["x1"]))
        & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )


def odd_crossings(edge_array: Column, px: Column, py: Column) -> Column:
    """Even-odd membership by the ray towards +x."""
    hits = F.filter(
        edge_array,
        lambda e: ((e["y1"] > py) != (e["y2"] > py))
        & (
            px
            < e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"])
        ),
    )
    return F.size(hits) % 2 == 1


def strictly_inside(edge_array: Column, px: Column, py: Column) -> Column:
    """Point within polygon; a point on the boundary is not within."""
    return odd_crossings(edge_array, px, py) & ~on_some_edge(edge_array, px, py)


def boxes_overlap(geom: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive bounding-box overlap: plain comparisons that reach the Parquet scan."""
    minx, miny, maxx, maxy = box
    return (
        (geom["minx"] <= F.lit(maxx))
        & (geom["maxx"] >= F.lit(minx))
        & (geom["miny"] <= F.lit(maxy))
        & (geom["maxy"] >= F.lit(miny))
    )


def _segment_meets_box(e: Column, box: tuple[float, float, float, float]) -> Column:
    """Separating-axis test of a segment against a box, touching included."""
    minx, miny, maxx, maxy = (F.lit(float(v)) for v in box)

    def side(x, y):
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    corners = F.array(side(minx, miny), side(minx, maxy), side(maxx, miny), side(maxx, maxy))
    return (
        (F.least(e["x1"], e["x2"]) <= maxx)
        & (F.greatest(e["x1"], e["x2"]) >= minx)
        & (F.least(e["y1"], e["y2"]) <= maxy)
        & (F.greatest(e["y1"], e["y2"]) >= miny)
        & (F.array_min(corners) <= 0)
        & (F.array_max(corners) >= 0)
    )


def intersects_box(geom: Column, box: tuple[float, float, float, float]) -> Column:
    """Geometry meets the envelope, boundaries included.

    The bounding-box comparisons alone decide points and boxes that are wholly inside; ring
    segments are looked at only for shapes that straddle the envelope.
    """
    minx, miny, maxx, maxy = box
    inside = (
        (geom["minx"] >= F.lit(minx))
        & (geom["maxx"] <= F.lit(maxx))
        & (geom["miny"] >= F.lit(miny))
        & (geom["maxy"] <= F.lit(maxy))
    )
    straddles = let(
        edges(geom),
        lambda segs: F.exists(segs, lambda e: _segment_meets_box(e, box))
        | odd_crossings(segs, F.lit(float(minx)), F.lit(float(miny))),
    )
    return boxes_overlap(geom, box) & (is_point(geom) | inside | straddles)


def _ring_moments(ring: Column, weight: Column) -> Column:
    """Twice the area and the first moments of one ring about its first vertex, sign removed.

    ``weight`` is +1 for an outer ring and -1 for a hole.
    """
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    base = ring[0]

    def moved(e):
        return F.struct(
            (e["x1"] - base["x"]).alias("x1"),
            (e["y1"] - base["y"]).alias("y1"),
            (e["x2"] - base["x"]).alias("x2"),
            (e["y2"] - base["y"]).alias("y2"),
        )

    # what the sums name several times is an element of its own, so that it is computed once
    turns = F.transform(
        F.transform(_ring_edges(ring), moved),
        lambda e: F.struct(
            (e["x1"] * e["y2"] - e["x2"] * e["y1"]).alias("cross"),
            (e["x1"] + e["x2"]).alias("x"),
            (e["y1"] + e["y2"]).alias("y"),
        ),
    )

    def step(acc, t):
        return F.struct(
            (acc["a"] + t["cross"]).alias("a"),
            (acc["mx"] + t["x"] * t["cross"]).alias("mx"),
            (acc["my"] + t["y"] * t["cross"]).alias("my"),
        )

    def finish(acc):
        sign = F.signum(acc["a"]) * weight
        return F.struct(
            (acc["a"] * sign).alias("a"),
            (acc["mx"] * sign / 3 + base["x"] * acc["a"] * sign).alias("mx"),
            (acc["my"] * sign / 3 + base["y"] * acc["a"] * sign).alias("my"),
        )

    return F.aggregate(turns, zero, step, finish)


def moments_of_parts(parts: Column) -> Column:
    """struct<a, mx, my>: area and first moments (both doubled) of a polygonal geometry."""
    per_ring = F.flatten(
        F.transform(
            parts,
            lambda part: F.transform(
                part,
                lambda ring, i: _ring_moments(ring, F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0))),
            ),
        )
    )
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        per_ring,
        zero,
        lambda acc, r: F.struct(
            (acc["a"] + r["a"]).alias("a"),
            (acc["mx"] + r["mx"]).alias("mx"),
            (acc["my"] + r["my"]).alias("my"),
        ),
    )


def centroid(geom: Column) -> Column:
    """struct<x, y>: the point itself, or the area-weighted centre of the polygons."""
    first = geom["parts"][0][0][0]
    of_polygon = let(
        moments_of_parts(geom["parts"]),
        lambda m: vertex(F.try_divide(m["mx"], m["a"]), F.try_divide(m["my"], m["a"])),
    )
    return F.when(is_point(geom), vertex(first["x"], first["y"])).otherwise(of_polygon)


def metric_parts(geom: Column) -> Column:
    return F.transform(
        geom["parts"], lambda part: F.transform(part, projection.ring_to_metres)
    )


def _hypot2(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def segment_distance2(e: Column, px: Column, py: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    len2 = _hypot2(dx, dy)
    along = F.when(
        len2 > 0,
        F.greatest(
            F.lit(0.0),
            F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / len2),
        ),
    ).otherwise(F.lit(0.0))
    return _hypot2(px - e["x1"] - along * dx, py - e["y1"] - along * dy)


def edges_distance(edge_array: Column, px: Column, py: Column) -> Column:
    """Distance to a polygonal shape given by its segments; 0 inside or on the boundary."""

    def nearest(segs):
        return F.sqrt(F.array_min(F.transform(segs, lambda e: segment_distance2(e, px, py))))

    return let(
        edge_array,
        lambda segs: F.when(odd_crossings(segs, px, py), F.lit(0.0)).otherwise(nearest(segs)),
    )


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(_hypot2(ax - bx, ay - by))


def segments_cross(a: Column, b: Column) -> Column:
    """Two segments share a point, touching and overlapping included."""

    def side(e, x, y):
        return F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))

    boxes = (
        (F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"]))
        & (F.least(b["x1"], b["x2"]) <= F.greatest(a["x1"], a["x2"]))
        & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"]))
        & (F.least(b["y1"], b["y2"]) <= F.greatest(a["y1"], a["y2"]))
    )
    return (
        boxes
        & (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) <= 0)
        & (side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) <= 0)
    )


def shapes_distance(ea: Column, eb: Column) -> Column:
    """Distance of two polygonal shapes given by their segments; 0 when they meet."""
    far = F.lit(float("inf"))

    def ends_to(segs, others):
        return F.array_min(
            F.transform(
                segs,
                lambda s: F.array_min(
                    F.transform(others, lambda o: segment_distance2(o, s["x1"], s["y1"]))
                ),
            )
        )

    meet = (
        F.exists(ea, lambda a: F.exists(eb, lambda b: segments_cross(a, b)))
        | odd_crossings(eb, ea[0]["x1"], ea[0]["y1"])
        | odd_crossings(ea, eb[0]["x1"], eb[0]["y1"])
    )
    gap = F.sqrt(F.least(F.coalesce(ends_to(ea, eb), far), F.coalesce(ends_to(eb, ea), far)))
    return F.when(meet, F.lit(0.0)).otherwise(gap)


def coordinates_ok(vertex_array: Column) -> Column:
    """Every vertex finite and inside the lon/lat ranges; no vertex at all is not valid."""
    # NaN sorts above every number, so the upper bound rejects NaN and infinities alike.
    return F.coalesce(
        (F.size(vertex_array) > 0)
        & F.forall(
            vertex_array,
            lambda v: F.coalesce(
                v["x"].between(F.lit(-180.0), F.lit(180.0))
                & v["y"].between(F.lit(-90.0), F.lit(90.0)),
                F.lit(False),
            ),
        ),
        F.lit(False),
    )


def nesting_ok(parts: Column) -> Column:
    """No empty list at any level of the nesting."""
    return F.coalesce(
        (F.size(parts) > 0)
        & F.forall(parts, lambda p: (F.size(p) > 0) & F.forall(p, lambda r: F.size(r) > 0)),
        F.lit(False),
    )


def parse_latlon_ring(text: Column) -> Column:
    """"lat,lon lat,lon ..." to a ring of (lon, lat) vertices; NULL when a vertex is malformed
    or fewer than four are given."""
    pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda p: F.length(p) > 0)
    vertices_read = F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_extract(p, r"^[^,]*,(.+)$", 1).try_cast("double").alias("x"),
            F.regexp_extract(p, r"^([^,]*),", 1).try_cast("double").alias("y"),
        ),
    )
    return let(
        vertices_read,
        lambda ring: F.when(
            (F.size(ring) >= 4)
            & F.forall(ring, lambda v: v["x"].isNotNull() & v["y"].isNotNull()),
            ring,
        ),
    )


def close_ring(ring: Column) -> Column:
    """Repeat the first vertex at the end unless it is already there."""
    last = F.element_at(ring, -1)
    return F.when(
        (ring[0]["x"] == last["x"]) & (ring[0]["y"] == last["y"]), ring
    ).otherwise(F.concat(ring, F.array(ring[0])))


def latlon_polygon(text: Column) -> Column:
    """Polygon geometry of a "lat,lon ..." text, NULL when it is malformed."""
    return let(
        parse_latlon_ring(text),
        lambda ring: F.when(
            ring.isNotNull(), from_parts(F.lit(POLYGON), F.array(F.array(close_ring(ring))))
        ),
    )


def _swapped(pair: Column) -> Column:
    return F.struct(F.get(pair, F.lit(1)).alias("x"), F.get(pair, F.lit(0)).alias("y"))


def _straight(pair: Column) -> Column:
    return F.struct(F.get(pair, F.lit(0)).alias("x"), F.get(pair, F.lit(1)).alias("y"))


def parts_from_coordinates(kind: Column, coordinates: Column, lat_first: bool) -> Column:
    """GeoJSON ``coordinates`` text to parts, by kind; NULL when the nesting does not fit."""
    pair = _swapped if lat_first else _straight

    def rings(part):
        return F.transform(part, lambda ring: F.transform(ring, pair))

    as_point = F.from_json(coordinates, "array<double>")
    as_polygon = F.from_json(coordinates, "array<array<array<double>>>")
    as_multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return (
        F.when(kind == POINT, F.array(F.array(F.array(pair(as_point)))))
        .when(kind == POLYGON, F.array(rings(as_polygon)))
        .when(kind == MULTIPOLYGON, F.transform(as_multi, rings))
    )


def from_geojson(text: Column) -> Column:
    """GeoJSON geometry text to a geometry; NULL when empty or not understood."""
    doc = F.from_json(text, "type string, coordinates string")
    return from_parts(
        doc["type"], parts_from_coordinates(doc["type"], doc["coordinates"], lat_first=False)
    )


def to_geojson(geom: Column) -> Column:
    """struct(type, coordinates) whose JSON rendering is the GeoJSON geometry, as text."""

    def pairs(ring):
        return F.transform(ring, lambda v: F.array(v["x"], v["y"]))

    def rings(part):
        return F.transform(part, pairs)

    parts = geom["parts"]
    body = (
        F.when(is_point(geom), F.to_json(pairs(parts[0][0])[0]))
        .when(geom["kind"] == POLYGON, F.to_json(rings(parts[0])))
        .otherwise(F.to_json(F.transform(parts, rings)))
    )
    return F.concat(
        F.lit('{"type":"'), geom["kind"], F.lit('","coordinates":'), body, F.lit("}")
    )
