"""Radius search in metres: one centre, or a table of centres."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import geometry, projection
from emberlake.operators import checks, grid
from emberlake.operators.filters import apply_filters
from emberlake.session import materialised


def metric_distance(geom: Column, cx: Column, cy: Column) -> Column:
    """Metres from a geometry to a projected centre; to the edge for polygons, 0 inside."""
    first = geom["parts"][0][0][0]
    px, py = projection.forward(F, first["x"], first["y"])
    to_shape = geometry.edges_distance(
        geometry.edges_of_parts(geometry.metric_parts(geom)), cx, cy
    )
    return F.when(geometry.is_point(geom), geometry.point_distance(px, py, cx, cy)).otherwise(
        to_shape
    )


def near(
    events: DataFrame, *, lon: float, lat: float, radius_m: float, limit: int = 100, **filters
) -> DataFrame:
    """Events within ``radius_m`` of a centre, nearest first, with ``distance_m``.

    The centre is projected once, to literals. Bounding-box comparisons in degrees go down to the
    scan; the exact distance is computed for what they leave.
    """
    checks.centre(lon, lat)
    checks.metres(radius_m, "radius_m")
    checks.limit(limit)
    cx, cy = projection.forward(math, lon, lat)
    box = projection.circle_bounds(lon, lat, radius_m)
    candidates = apply_filters(events, **filters).where(
        geometry.boxes_overlap(F.col("geom"), box)
    )
    hits = grid.computed(
        candidates, distance_m=metric_distance(F.col("geom"), F.lit(cx), F.lit(cy))
    ).where(F.col("distance_m") <= radius_m)
    return hits.orderBy("distance_m", "id").limit(limit)


def _first_per_place(events: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` events per distinct geometry, smallest ids first.

    Equal geometries are equally far from any centre and ties go to the smaller id, so the others
    can never be among the ``limit`` nearest. The rank filter runs per task before the shuffle. A place is
    known by its text: sorting compares hashes, and texts where these are equal, but never nested arrays.
    """
    parts = F.col("geom")["parts"]
    place = Window.partitionBy(F.xxhash64(parts), parts.cast("string")).orderBy("id")
    return (
        events.select("id", "geom")
        .withColumn("_turn", F.row_number().over(place))
        .where(F.col("_turn") <= limit)
        .drop("_turn")
    )


# A cell of more items than this share of the limit is split into 4 x 4, at most so many times.
LEAF_SHARE, MIN_LEAF, MAX_LEVELS, STEP_BITS = 4, 4, 20, 2
BOX = ["minx", "miny", "maxx", "maxy"]
POINTS = -1


def _items(events: DataFrame, radius_m: float) -> DataFrame:
    """Places in metres: id, box, outline of areas, and the position (u, v) on the grid of their size class.

    Areas of a class have half diagonals up to 2^class metres and are filed by the middle of their box, under cells at least as
    wide as two of these and as the radius.
    """
    on_point = geometry.is_point(F.col("geom"))
    first = F.col("geom")["parts"][0][0][0]
    # points and areas in one pass: what leads to the events is not computed once for each
    measured = grid.computed(
        events.select("id", "geom", on_point.alias("on_point")).where(F.col("on_point").isNotNull()),
        m=F.when(F.col("on_point"), projection.to_metres(first["x"], first["y"])),
        segs=F.when(~F.col("on_point"), geometry.edges_of_parts(geometry.metric_parts(F.col("geom")))),
    )
    xs = F.flatten(F.transform("segs", lambda e: F.array(e["x1"], e["x2"])))
    ys = F.flatten(F.transform("segs", lambda e: F.array(e["y1"], e["y2"])))

    def of(position, corner):
        return F.when(F.col("on_point"), position).otherwise(corner)

    boxed = grid.computed(
        measured.select("id", "on_point", "m", "segs"),
        minx=of(F.col("m.x"), F.array_min(xs)), miny=of(F.col("m.y"), F.array_min(ys)),
        maxx=of(F.col("m.x"), F.array_max(xs)), maxy=of(F.col("m.y"), F.array_max(ys)),
    )
    half = geometry.point_distance(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")) / 2
    cls = F.ceil(F.log2(F.greatest(half, F.lit(1.0)))).cast("int")
    items = boxed.select("id", of(F.lit(POINTS), cls).alias("cls"), F.col("segs").cast(SEGMENTS), *BOX)
    side = _side(radius_m)
    return items.select(
        "*",
        ((F.col("minx") + F.col("maxx")) / 2 / side).alias("u"),
        ((F.col("miny") + F.col("maxy")) / 2 / side).alias("v"),
    )


SEGMENTS = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _side(radius_m: float) -> Column:
    """Width of a class's widest cells."""
    wide = F.pow(F.lit(2.0), F.col("cls") + 1)
    return F.when(F.col("cls") == POINTS, F.lit(float(radius_m))).otherwise(F.greatest(F.lit(float(radius_m)), wide))


CELL = ["cls", "kx", "ky"]


def _pyramid(items: DataFrame, leaf: int) -> tuple[list[DataFrame], DataFrame]:
    """Cell counts and tight boxes per level, and the items with the cell they end up in.

    Level 0 has all cells; a deeper one has the parts of the cells above that hold more than ``leaf`` items, unless these
    lie at one place.
    """
    levels, leaves, rest = [], [], items
    for level in range(MAX_LEVELS + 1):
        scale = F.lit(float(2 ** (STEP_BITS * level)))
        placed = rest.withColumn("kx", F.floor(F.col("u") * scale).cast("bigint")).withColumn(
            "ky", F.floor(F.col("v") * scale).cast("bigint")
        )
        counts = placed.groupBy(*CELL).agg(
            F.count("*").alias("n"),
            F.min("minx").alias("minx"), F.min("miny").alias("miny"),
            F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
            ((F.min("u") < F.max("u")) | (F.min("v") < F.max("v"))).alias("apart"),
        )
        divided = F.col("apart") & (F.col("n") > leaf) & F.lit(level < MAX_LEVELS)
        counts = materialised(counts.withColumn("divided", divided).drop("apart"), "cells")
        levels.append(counts)
        if counts.where("divided").isEmpty():
            leaves.append(placed.withColumn("level", F.lit(level)))
            break
        judged = grid.spread_join(placed, counts.select(*CELL, "divided"), CELL, F.col("id"))
        judged = materialised(judged, "items")
        leaves.append(judged.where(~F.col("divided")).drop("divided").withColumn("level", F.lit(level)))
        rest = judged.where("divided").drop("divided", "kx", "ky")
    return levels, reduce(DataFrame.unionByName, leaves).drop("u", "v")


def _to_box(px: Column, py: Column) -> tuple[Column, Column]:
    """Least and greatest distance of a position to the row's box."""
    zero = F.lit(0.0)
    near = geometry.point_distance(
        F.greatest(zero, F.col("minx") - px, px - F.col("maxx")),
        F.greatest(zero, F.col("miny") - py, py - F.col("maxy")), zero, zero,
    )
    far = geometry.point_distance(
        F.greatest(F.col("maxx") - px, px - F.col("minx")), F.greatest(F.col("maxy") - py, py - F.col("miny")), zero, zero
    )
    return near, far


def _reached_cells(placed: DataFrame, levels: list[DataFrame], radius_m: float, limit: int) -> DataFrame:
    """(centre_id, px, py, bound, level, cell): the undivided cells that can hold one of a centre's nearest.

    Level by level, the cells of a centre taken by their greatest distance tell how far away its ``limit``-th place
    can be at most; cells beyond that bound drop out before their parts are looked at.
    """
    # at most as many size classes as there are powers of two
    classes = sorted(r["cls"] for r in levels[0].select("cls").distinct().collect())
    if not classes:
        classes = [POINTS]
    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    side = _side(radius_m)
    classed = placed.withColumn("cls", F.explode(F.array(*[F.lit(c) for c in classes])))
    asked = classed.select("*", F.explode(probes).alias("o")).select(
        "centre_id", "px", "py", "cls", F.lit(float(radius_m)).alias("bound"),
        (F.floor(F.col("px") / side).cast("bigint") + F.col("o.i")).alias("kx"),
        (F.floor(F.col("py") / side).cast("bigint") + F.col("o.j")).alias("ky"),
    )
    near, far = _to_box(F.col("px"), F.col("py"))
    by_reach = Window.partitionBy("centre_id").orderBy("far", "level", *CELL).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("centre_id")
    across = 2**STEP_BITS
    settled = None
    for level, counts in enumerate(levels):
        fresh = grid.spread_join(asked, counts, CELL, F.col("centre_id")).withColumn("level", F.lit(level))
        fresh = grid.computed(fresh, near=near, far=far).where(F.col("near") <= F.col("bound"))
        state = fresh if settled is None else settled.unionByName(fresh)
        enough = F.when(F.sum("n").over(by_reach) >= limit, F.col("far"))
        # a hair more for rounding in the distance to outlines
        bound = F.least(F.col("bound"), F.min("enough").over(whole) * (1 + 1e-9) + 1e-6)
        state = materialised(
            state.withColumn("enough", enough).withColumn("bound", bound).drop("enough")
            .where(F.col("near") <= F.col("bound")),
            "reached",
        )
        # only cells of this level can still be divided
        open_ = F.col("divided") & (F.col("level") == level)
        settled = state.where(~open_)
        parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(across) for j in range(across)])
        asked = state.where(open_).select("centre_id", "px", "py", "cls", "bound", "kx", "ky", F.explode(parts).alias("o"))
        asked = asked.withColumn("kx", across * F.col("kx") + F.col("o.i")).withColumn(
            "ky", across * F.col("ky") + F.col("o.j")
        ).drop("o")
    return settled.select("centre_id", "px", "py", "bound", "level", *CELL)


def _candidates(reached: DataFrame, leaves: DataFrame) -> DataFrame:
    """Pairs of a centre and a place whose box is within the centre's bound."""
    pairs = grid.spread_join(reached, leaves, ["level", *CELL], F.col("centre_id"))
    near, _ = _to_box(F.col("px"), F.col("py"))
    return pairs.where(near <= F.col("bound"))


def near_join(
    events: DataFrame, centres: DataFrame, *, radius_m: float, limit: int = 100, **filters
) -> DataFrame:
    """The ``limit`` nearest events within ``radius_m`` of every row of centres(centre_id, lon, lat).

    A pyramid of cell counts bounds the distance of each centre's last place before any pair is made. Only the events of
    cells within that bound are measured, a small multiple of ``limit`` per centre however crowded its surroundings.
    Repeated centre ids are ranked as one centre.
    """
    checks.metres(radius_m, "radius_m")
    checks.limit(limit)
    placed = grid.computed(
        centres, p=projection.to_metres(F.col("lon"), F.col("lat"))
    ).select("centre_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    leaf = max(MIN_LEAF, limit // LEAF_SHARE)
    items = _items(_first_per_place(apply_filters(events, **filters), limit), radius_m)
    levels, leaves = _pyramid(materialised(items, "items"), leaf)
    pairs = _candidates(_reached_cells(placed, levels, radius_m, limit), leaves)
    px, py = F.col("px"), F.col("py")
    apart = F.when(
        F.col("segs").isNull(), geometry.point_distance(F.col("minx"), F.col("miny"), px, py)
    ).otherwise(geometry.edges_distance(F.col("segs"), px, py))
    ranked = Window.partitionBy("centre_id").orderBy("distance_m", "id")
    return (
        pairs.select("centre_id", "id", apart.alias("distance_m"))
        .where(F.col("distance_m") <= radius_m)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= limit)
    )
