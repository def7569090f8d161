"""Audit of polygon rings: self-crossings, and area and centre under the even-odd rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import geometry
from emberlake.operators import grid

# Rings of up to this many segments are judged within their row, longer ones by a grid join.
SHORT_RING = 24
# Share of its extent squared below which an area is rounding alone.
FLAT = 1e-14


def _sound_edges(ring: Column) -> Column:
    """Segments of a ring without those of no length."""
    return F.filter(
        geometry.edges_of_parts(F.array(F.array(ring))),
        lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]),
    )


def _conflict(a: Column, b: Column, i: Column, j: Column, n: Column) -> Column:
    """Segments i < j of a ring of n share more than their common corner."""
    ax, ay = a["x2"] - a["x1"], a["y2"] - a["y1"]
    bx, by = b["x2"] - b["x1"], b["y2"] - b["y1"]
    folds = (ax * by == ay * bx) & (ax * bx + ay * by < 0)
    neighbours = (j == i + 1) | ((i == 0) & (j == n - 1))
    return F.when(neighbours, folds).otherwise(geometry.segments_cross(a, b))


def _height(a: Column, b: Column) -> Column:
    """Height at which the lines of two segments meet; NULL for parallel ones."""
    ax, ay = a["x2"] - a["x1"], a["y2"] - a["y1"]
    bx, by = b["x2"] - b["x1"], b["y2"] - b["y1"]
    along = F.try_divide((b["x1"] - a["x1"]) * by - (b["y1"] - a["y1"]) * bx, ax * by - ay * bx)
    return a["y1"] + along * ay


def _short_crossings(segs: Column) -> Column:
    """Crossing heights of a short ring, pair by pair within the row."""
    n = F.size(segs)

    def with_later(a, i):
        later = F.filter(segs, lambda b, j: (j > i) & _conflict(a, b, i, j, n))
        return F.transform(later, lambda b: _height(a, b))

    return F.flatten(F.transform(segs, with_later))


def _long_crossings(shapes: DataFrame) -> DataFrame:
    """(key, y) per crossing of the rings of many segments.

    Segments meet in the cells of a grid laid over their own ring, sized to its segment count, so
    a long ring is spread over its cells and only near segments are compared.
    """
    xs, ys = F.col("segs")["x1"], F.col("segs")["y1"]
    sized = grid.computed(
        shapes.select("key", "segs"),
        n=F.size("segs"),
        ox=F.array_min(xs),
        oy=F.array_min(ys),
        extent=F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)),
    )
    side = F.col("extent") / F.ceil(F.sqrt(F.col("n").cast("double")))
    segs = sized.select(
        "key", "n", "ox", "oy", side.alias("side"), F.posexplode("segs").alias("i", "e")
    )

    def cell(pick, axis):
        end = pick(F.col(f"e.{axis}1"), F.col(f"e.{axis}2"))
        return F.floor((end - F.col(f"o{axis}")) / F.col("side")).cast("bigint")

    placed = grid.computed(
        segs,
        lx=cell(F.least, "x"),
        hx=cell(F.greatest, "x"),
        ly=cell(F.least, "y"),
        hy=cell(F.greatest, "y"),
    )
    filed = (
        placed.withColumn("cx", F.explode(F.sequence("lx", "hx")))
        .withColumn("cy", F.explode(F.sequence("ly", "hy")))
        .groupBy("key", "cx", "cy")
        .agg(F.collect_list(F.struct("n", "i", "e", "lx", "ly")).alias("met"))
        # a join of the cells with themselves would be broadcast: the planner cannot know their number
        .where(F.col("key").isNotNull() & (F.size("met") > 1))
    )
    pairs = (
        filed.withColumn("p", F.explode("met")).withColumn("q", F.explode("met")).where(
            (F.col("p.i") < F.col("q.i"))
            & (F.col("cx") == F.greatest("p.lx", "q.lx"))
            & (F.col("cy") == F.greatest("p.ly", "q.ly"))
        )
    )
    a, b = F.col("p.e"), F.col("q.e")
    return pairs.where(_conflict(a, b, F.col("p.i"), F.col("q.i"), F.col("p.n"))).select(
        "key", _height(a, b).alias("y")
    )


def _even_odd_moments(segs: Column, heights: Column) -> Column:
    """struct<a, mx, my> of the even-odd region: horizontal slabs between corner and crossing
    heights, in each of which the segments keep their order from left to right."""

    def slab(lo, hi):
        h, ym = hi - lo, (lo + hi) / 2
        spanning = F.filter(
            segs,
            lambda e: (F.least(e["y1"], e["y2"]) <= lo)
            & (F.greatest(e["y1"], e["y2"]) >= hi)
            & (e["y1"] != e["y2"]),
        )

        def line(e):
            slope = F.try_divide(e["x2"] - e["x1"], e["y2"] - e["y1"])
            return F.struct((e["x1"] + slope * (ym - e["y1"])).alias("x"), slope.alias("k"))

        lines = F.sort_array(F.transform(spanning, line))
        signed = F.transform(
            lines,
            lambda l, i: F.struct(
                (F.when(i % 2 == 1, h).otherwise(-h)).alias("s"), l["x"].alias("x"), l["k"].alias("k")
            ),
        )
        return F.transform(
            signed,
            lambda l: F.struct(
                (l["s"] * l["x"]).alias("a"),
                (l["s"] * (l["x"] * l["x"] + l["k"] * l["k"] * h * h / 12) / 2).alias("mx"),
                (l["s"] * (ym * l["x"] + l["k"] * h * h / 12)).alias("my"),
            ),
        )

    n = F.greatest(F.size(heights) - 1, F.lit(0))
    terms = F.flatten(F.zip_with(F.slice(heights, 1, n), F.slice(heights, 2, n), slab))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        terms,
        zero,
        lambda acc, t: F.struct(
            (acc["a"] + t["a"]).alias("a"),
            (acc["mx"] + t["mx"]).alias("mx"),
            (acc["my"] + t["my"]).alias("my"),
        ),
    )


def audit_rings(rings: DataFrame) -> DataFrame:
    """rings(key, ring) with their crossings and the area and centre of the repaired region.

    Membership by the even-odd rule needs no repair. Area and centre of a crossing ring come from
    its slabs; a sound ring takes the ordinary formula. ``empty`` marks rings that enclose nothing
    and belong in quarantine.
    """
    keyed = rings.select("key", "ring")
    shapes = grid.computed(keyed, segs=_sound_edges(F.col("ring")))
    is_short = F.size("segs") <= SHORT_RING
    short = grid.computed(shapes.where(is_short), found=_short_crossings(F.col("segs")))
    # few corners are few segments, so the segments of most rings are not needed a second time
    many = grid.computed(keyed.where(F.size("ring") > SHORT_RING), segs=_sound_edges(F.col("ring")))
    long = many.where(~is_short)
    crossed = _long_crossings(long).groupBy("key").agg(
        F.count("*").alias("crossings"), F.collect_set("y").alias("heights")
    )
    judged = short.select(
        "key", "ring", "segs", F.size("found").cast("bigint").alias("crossings"),
        F.array_compact("found").alias("heights"),
    ).unionByName(
        long.join(crossed.hint("merge"), "key", "left").select(
            "key", "ring", "segs", F.coalesce("crossings", F.lit(0)).alias("crossings"),
            F.coalesce("heights", F.array().cast("array<double>")).alias("heights"),
        )
    )
    plain = geometry.let(
        geometry.moments_of_parts(F.array(F.array(F.col("ring")))),
        lambda m: F.struct(
            (m["a"] / 2).alias("a"), (m["mx"] / 2).alias("mx"), (m["my"] / 2).alias("my")
        ),
    )
    crossing = F.col("crossings") > 0
    levels = F.sort_array(
        F.array_distinct(F.concat(F.col("segs")["y1"], F.col("heights")))
    )
    # named four times below
    judged = grid.computed(judged, levels=F.when(crossing, levels))
    region = F.when(crossing, _even_odd_moments(F.col("segs"), F.col("levels"))).otherwise(plain)
    flat = F.coalesce(F.col("m.a") <= F.lit(FLAT) * F.col("extent") * F.col("extent"), F.lit(True))
    xs, ys = F.col("segs")["x1"], F.col("segs")["y1"]
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    return grid.computed(judged, m=region, extent=extent).select(
        "key",
        "crossings",
        crossing.alias("crossing"),
        F.col("m.a").alias("area"),
        F.when(~flat, F.try_divide("m.mx", "m.a")).alias("x"),
        F.when(~flat, F.try_divide("m.my", "m.a")).alias("y"),
        flat.alias("empty"),
    )
