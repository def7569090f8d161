"""Event frames from plain rows, and plain-Python geometry for brute-force checks."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.functions import projection, values

BASE = dt.datetime(2026, 7, 1, 12, tzinfo=dt.timezone.utc)


def geom_value(kind, parts):
    flat = [v for part in parts for ring in part for v in ring]
    xs, ys = [v[0] for v in flat], [v[1] for v in flat]
    return (kind, parts, min(xs), min(ys), max(xs), max(ys))


def point(lon, lat):
    return geom_value("Point", [[[(float(lon), float(lat))]]])


def polygon(*ring):
    ring = [(float(x), float(y)) for x, y in ring]
    if ring[0] != ring[-1]:
        ring.append(ring[0])
    return geom_value("Polygon", [[ring]])


def square(lon, lat, half):
    return polygon(
        (lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half)
    )


def event(external_id, geom, *, source="effis", hazard_type="wildfire", severity=2, hours=0,
          starts_at=None, ends_at=None, attrs="{}"):
    return {
        "source": source,
        "hazard_type": hazard_type,
        "external_id": external_id,
        "severity": severity,
        "starts_at": starts_at or BASE + dt.timedelta(hours=hours),
        "ends_at": ends_at,
        "geom": geom,
        "attrs": attrs,
        "content_hash": external_id,
    }


FIELDS = ["source", "hazard_type", "external_id", "severity", "starts_at", "ends_at", "geom", "attrs", "content_hash"]


def events_frame(spark, rows):
    schema = schemas.EVENTS
    from pyspark.sql import types as T

    schema = T.StructType([f for name in FIELDS for f in schema.fields if f.name == name])
    df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], schema)
    return df.withColumn("id", values.event_id(F.col("source"), F.col("external_id")))


# --- brute force ---------------------------------------------------------------------------


def metres(lon, lat):
    return projection.forward(math, lon, lat)


def shape_edges(geom):
    out = []
    for part in geom[1]:
        for ring in part:
            pts = [metres(*v) for v in ring]
            out += list(zip(pts[:-1], pts[1:]))
    return out


def _seg(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def _inside(p, edges):
    odd = False
    for (x1, y1), (x2, y2) in edges:
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (x2 - x1) * (p[1] - y1) / (y2 - y1):
            odd = not odd
    return odd


def _cross(a, b, c, d):
    def side(p, q, r):
        v = (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        return (v > 0) - (v < 0)

    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def distance(g, h):
    """Metres between two geometries."""
    if g[0] == "Point" and h[0] == "Point":
        return math.dist(metres(*g[1][0][0][0]), metres(*h[1][0][0][0]))
    if g[0] == "Point" or h[0] == "Point":
        spot, shape = (g, h) if g[0] == "Point" else (h, g)
        p, edges = metres(*spot[1][0][0][0]), shape_edges(shape)
        return 0.0 if _inside(p, edges) else min(_seg(p, a, b) for a, b in edges)
    e, f = shape_edges(g), shape_edges(h)
    if _inside(e[0][0], f) or _inside(f[0][0], e) or any(_cross(*s, *t) for s in e for t in f):
        return 0.0
    return min(
        min(_seg(p, a, b) for p, _ in e for a, b in f), min(_seg(p, a, b) for p, _ in f for a, b in e)
    )


def brute_dbscan(items, eps, min_points):
    """{id: label} of items [(id, geom)]: label is the smallest core id of the cluster."""
    ids = [i for i, _ in items]
    near = {i: set() for i in ids}
    for a, (i, g) in enumerate(items):
        for j, h in items[a:]:
            if distance(g, h) <= eps:
                near[i].add(j)
                near[j].add(i)
    core = {i for i in ids if len(near[i]) >= min_points}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j in label:
                continue
            label[j] = i
            stack += [k for k in near[j] if k in core and k not in label]
    out = dict(label)
    for i in ids:
        if i not in core:
            homes = [label[j] for j in near[i] if j in core]
            if homes:
                out[i] = min(homes)
    return out
