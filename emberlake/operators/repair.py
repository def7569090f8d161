"""Repair of self-crossing rings: the even-odd region of a ring as polygons that do not cross."""

from __future__ import annotations

import json
import math
import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlake import schemas
from emberlake.functions import geometry
from emberlake.operators import grid

# The helper travels with its code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rings of up to this many segments are tested within the query; longer ones by the helper below.
SHORT_RING = 24


def _point(x: float, y: float) -> tuple[float, float]:
    # crossings found from either segment are one node
    return round(x, 12), round(y, 12)


def _meetings(segs: list) -> dict[int, set]:
    """Points at which a segment must be cut: where it meets another one anywhere but at its own ends."""
    cuts = defaultdict(set)
    order = sorted(range(len(segs)), key=lambda i: min(segs[i][0][0], segs[i][1][0]))
    active: list[int] = []
    for j in order:
        (cx, cy), (dx, dy) = segs[j]
        left = min(cx, dx)
        active = [i for i in active if max(segs[i][0][0], segs[i][1][0]) >= left]
        for i in active:
            (ax, ay), (bx, by) = segs[i]
            if max(ay, by) < min(cy, dy) or max(cy, dy) < min(ay, by):
                continue
            ux, uy, vx, vy = bx - ax, by - ay, dx - cx, dy - cy
            turn = ux * vy - uy * vx
            if turn:
                t = ((cx - ax) * vy - (cy - ay) * vx) / turn
                s = ((cx - ax) * uy - (cy - ay) * ux) / turn
                if 0 <= t <= 1 and 0 <= s <= 1:
                    at = _point(ax + t * ux, ay + t * uy)
                    cuts[i].add(at)
                    cuts[j].add(at)
            elif ux * (cy - ay) == uy * (cx - ax):
                # on one line: each is cut at the ends of the other
                for p in segs[j]:
                    if min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
                        cuts[i].add(_point(*p))
                for p in segs[i]:
                    if min(cx, dx) <= p[0] <= max(cx, dx) and min(cy, dy) <= p[1] <= max(cy, dy):
                        cuts[j].add(_point(*p))
        active.append(j)
    return cuts


def _boundary(segs: list) -> set:
    """Pieces between cuts; one that is run over an even number of times has the same on both sides."""
    cuts, edges = _meetings(segs), set()
    for i, (a, b) in enumerate(segs):
        along = sorted({a, b} | cuts[i], key=lambda p: (p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]))
        for p, q in zip(along, along[1:]):
            edges ^= {(min(p, q), max(p, q))}
    return edges


def _inside_left(edges: set) -> Iterator[tuple]:
    """The pieces, turned so that the region is on their left."""
    for (ax, ay), (bx, by) in sorted(edges):
        x, y = (ax + bx) / 2, (ay + by) / 2
        level = ay == by
        beyond = 0
        for (px, py), (qx, qy) in edges:
            if (px, py) == (ax, ay) and (qx, qy) == (bx, by):
                continue
            if level:
                px, py, qx, qy, u, v = py, px, qy, qx, y, x
            else:
                u, v = x, y
            if (py > v) != (qy > v) and u < px + (qx - px) * (v - py) / (qy - py):
                beyond += 1
        if level:
            forward = beyond % 2 == 1
        else:
            forward = (beyond % 2 == 0) == (by > ay)
        yield ((ax, ay), (bx, by)) if forward else ((bx, by), (ax, ay))


def _loops(edges: set) -> list[list]:
    """Closed walks along the pieces, each around one face of the region."""
    leaving = defaultdict(list)
    for a, b in _inside_left(edges):
        leaving[a].append(b)
    out = []
    for start in sorted(leaving):
        while leaving[start]:
            walk = [start]
            before, here = start, leaving[start].pop()
            while here != start:
                walk.append(here)
                back = math.atan2(before[1] - here[1], before[0] - here[0])
                turn = [
                    (back - math.atan2(n[1] - here[1], n[0] - here[0])) % (2 * math.pi) or 2 * math.pi
                    for n in leaving[here]
                ]
                before, here = here, leaving[here].pop(turn.index(min(turn)))
            out.append([*walk, start])
    return out


def _area(loop: list) -> float:
    ox, oy = loop[0]
    return sum((a[0] - ox) * (b[1] - oy) - (b[0] - ox) * (a[1] - oy) for a, b in zip(loop, loop[1:])) / 2


def _holds(loop: list, x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(loop, loop[1:]):
        if (ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay):
            odd = not odd
    return odd


def untangled(ring: list[tuple[float, float]]) -> list[list[list[tuple[float, float]]]] | None:
    """Polygons (outer ring, then holes) of the region a closed ring bounds by the even-odd rule; None if it bounds nothing.

    A ring that does not cross itself stays as it is.
    """
    ring = [(float(x), float(y)) for x, y in ring]
    segs = [(a, b) for a, b in zip(ring, ring[1:]) if a != b]
    n, cuts = len(segs), _meetings(segs)
    simple = all(p in map(lambda q: _point(*q), segs[i]) for i, at in cuts.items() for p in at)
    corners = [a for a, _ in segs]
    if simple and n > 2 and len(set(corners)) == n:
        return [[ring]] if _area(ring) else None
    loops = [loop for loop in _loops(_boundary([(_point(*a), _point(*b)) for a, b in segs])) if len(loop) > 3]
    outer = [[loop] for loop in loops if _area(loop) > 0]
    for hole in (loop for loop in loops if _area(loop) < 0):
        x, y = (hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2
        around = [part for part in outer if _holds(part[0], x, y)] or outer
        min(around, key=lambda part: _area(part[0])).append(hole)
    return outer or None


@F.pandas_udf(T.StringType())
def _untangled_text(rings: pd.Series) -> pd.Series:
    def parts(text):
        if text is None:
            return None
        found = untangled(json.loads(text))
        return found and json.dumps([[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in found])

    return rings.map(parts, na_action="ignore")


def may_cross(ring: Column) -> Column:
    """Whether a ring needs a closer look: two of its segments share more than a corner, or it is long, or flat."""

    def conflicts(segs):
        n = F.size(segs)

        def with_later(a, i):
            def meets(b, j):
                neighbours = (j == i + 1) | ((i == 0) & (j == n - 1))
                ax, ay = a["x2"] - a["x1"], a["y2"] - a["y1"]
                bx, by = b["x2"] - b["x1"], b["y2"] - b["y1"]
                # neighbours share their corner; only a fold back is more
                folds = (ax * by == ay * bx) & (ax * bx + ay * by <= 0)
                return (j > i) & F.when(neighbours, folds).otherwise(geometry.segments_cross(a, b))

            return F.size(F.filter(segs, meets)) > 0

        return (n > SHORT_RING) | (n < 3) | F.exists(F.transform(segs, with_later), lambda hit: hit)

    return geometry.let(geometry.edges_of_parts(F.array(F.array(ring))), conflicts)


def with_repaired(polygons: DataFrame) -> DataFrame:
    """Polygons of one ring in ``geom`` made valid: unchanged, a polygon or several, or NULL when the region is empty.

    Only the rings that ``may_cross`` leave the engine.
    """
    ring = F.col("geom")["parts"][0][0]
    looked = grid.computed(polygons, _look=F.coalesce(may_cross(ring), F.lit(False)))
    text = F.to_json(F.transform(ring, lambda v: F.array(v["x"], v["y"])))
    read = looked.withColumn("_text", _untangled_text(F.when(F.col("_look"), text)))
    parts = F.from_json("_text", schemas.PARTS)
    kind = F.when(F.size(parts) > 1, geometry.MULTIPOLYGON).otherwise(geometry.POLYGON)
    # a step of its own: no Python function may end up inside the expressions on its result
    made = grid.computed(read, _made=geometry.from_parts(kind, parts))
    return made.withColumn("geom", F.when(F.col("_look"), F.col("_made")).otherwise(F.col("geom"))).drop(
        "_look", "_text", "_made"
    )
