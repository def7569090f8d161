"""Density clusters (DBSCAN) of event geometries in metres, and their summaries.

Places with the same geometry are one weighted site. Sites fall into square cells whose diagonal
is ``eps``: all sites of a cell are neighbours, so a cell is at most one piece of a cluster, and
one that weighs ``min_points`` is core as a whole. What remains are questions between a site (or a
cell) and the cells around it. Their tight boxes answer most; the open ones are asked again of
ever smaller sub-cells, and only short lists of sites are compared one by one.

Areas join in by a cell cover: an outline is a site of every cell that it meets or fills, as far as the
cell holds a point or a piece of some outline. Two areas that overlap share such a cell, and the closest
places of two that do not lie on their outlines, so beyond the cover only outlines matter, cut into pieces at the
cell borders. Members are compared one by one only where one of the two has no crowded cell at all, which leaves fewer than
``min_points`` of them per cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions import geometry, projection
from emberlake.operators import checks, cover, grid
from emberlake.operators.components import components
from emberlake.operators.filters import apply_filters
from emberlake.session import materialised


# Bits per refinement step (8 x 8 sub-cells) and the longest site lists compared one by one.
STEP_BITS = 3
SHORT = 64
MAX_BITS = 36

BOX = ["minx", "miny", "maxx", "maxy"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- boxes -------------------------------------------------------------------------------------


def _sub_cell(bits: int) -> list[Column]:
    """Sub-cell numbers of a site. ``u`` and ``v`` are positions in cells, so that scaling by a
    power of two is exact and sub-cells nest."""
    scale = F.lit(float(2**bits))
    return [
        F.floor(F.col("u") * scale).cast("bigint").alias("kx"),
        F.floor(F.col("v") * scale).cast("bigint").alias("ky"),
    ]


def _boxes(sites: DataFrame, bits: int) -> DataFrame:
    """Per non-empty sub-cell: site count m, weight n and the tight box of its sites."""
    return (
        sites.select(*_sub_cell(bits), "x", "y", "w")
        .groupBy("kx", "ky")
        .agg(
            F.count("*").alias("m"),
            F.sum("w").alias("n"),
            F.min("x").alias("minx"),
            F.min("y").alias("miny"),
            F.max("x").alias("maxx"),
            F.max("y").alias("maxy"),
        )
    )


def _children(sites: DataFrame, bits: int, parents: DataFrame) -> DataFrame:
    """Boxes one step below the given parents, with the parent's numbers in (kx, ky) and their
    own in (jx, jy)."""
    finer = _boxes(sites, bits + STEP_BITS).select(
        F.shiftright("kx", STEP_BITS).alias("px"),
        F.shiftright("ky", STEP_BITS).alias("py"),
        F.col("kx").alias("jx"),
        F.col("ky").alias("jy"),
        "m",
        "n",
        *BOX,
    )
    wanted = parents.select(F.col("kx").alias("px"), F.col("ky").alias("py")).distinct()
    return finer.join(wanted, ["px", "py"], "left_semi").withColumnsRenamed({"px": "kx", "py": "ky"})


def _point_bounds(x: Column, y: Column) -> tuple[Column, Column]:
    """Nearest and farthest distance of a position to the row's box."""
    zero = F.lit(0.0)
    near = geometry.point_distance(
        F.greatest(zero, F.col("minx") - x, x - F.col("maxx")),
        F.greatest(zero, F.col("miny") - y, y - F.col("maxy")),
        zero,
        zero,
    )
    far = geometry.point_distance(
        F.greatest(F.col("maxx") - x, x - F.col("minx")),
        F.greatest(F.col("maxy") - y, y - F.col("miny")),
        zero,
        zero,
    )
    return near, far


def _shape_bounds(pairs: DataFrame) -> DataFrame:
    """Bounds for the row's segments: distance to the box centre, give or take half a diagonal."""
    cx, cy = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2
    half = geometry.point_distance(F.col("minx"), F.col("miny"), cx, cy)
    measured = grid.computed(pairs, mid=geometry.edges_distance(F.col("segs"), cx, cy), half=half)
    return measured.withColumn("near", F.col("mid") - F.col("half")).withColumn(
        "far", F.col("mid") + F.col("half")
    )


# --- a site or shape against the cells around it -----------------------------------------------


def _weigh(
    pairs: DataFrame, right: DataFrame, left: list[str], eps: float, longest: int
) -> DataFrame:
    """(lid, cx, cy, n): weight of the right sites of each cell within ``eps`` of the left object.

    ``pairs`` holds the left object's columns and one candidate box per row. Boxes wholly within
    reach count as they are, boxes out of reach drop out, the others are opened: short ones site
    by site, long ones by their sub-cells. ``longest`` is the largest site count of any box.
    """
    reach = F.lit(float(eps))
    keep = ["lid", *left, "cx", "cy"]
    settled = []
    bits = 0
    while True:
        if left == ["segs"]:
            judged = _shape_bounds(pairs)
        else:
            near, far = _point_bounds(F.col("lx"), F.col("ly"))
            judged = grid.computed(pairs, near=near, far=far)
        judged = judged.where(F.col("near") <= reach)
        settled.append(judged.where(F.col("far") <= reach).select("lid", "cx", "cy", "n"))
        opened = judged.where(F.col("far") > reach)
        last = longest <= SHORT or bits + STEP_BITS > MAX_BITS
        short = opened if last else opened.where(F.col("m") <= SHORT)
        listed = right.select(*_sub_cell(bits), "x", "y", "w")
        one_by_one = _with_sites(short.select(*keep, "kx", "ky"), listed, ["kx", "ky"], longest)
        if left == ["segs"]:
            apart = geometry.edges_distance(F.col("segs"), F.col("x"), F.col("y"))
        else:
            apart = geometry.point_distance(F.col("lx"), F.col("ly"), F.col("x"), F.col("y"))
        settled.append(
            one_by_one.where(apart <= reach).select("lid", "cx", "cy", F.col("w").alias("n"))
        )
        if last:
            break
        heavy = materialised(opened.where(F.col("m") > SHORT).select(*keep, "kx", "ky"), "open")
        if heavy.isEmpty():
            break
        finer = materialised(_children(right, bits, heavy), "boxes")
        longest = finer.agg(F.max("m")).first()[0]
        pairs = (
            heavy.join(finer, ["kx", "ky"])
            .drop("kx", "ky")
            .withColumnsRenamed({"jx": "kx", "jy": "ky"})
        )
        bits += STEP_BITS
    return _union(settled).groupBy("lid", "cx", "cy").agg(F.sum("n").alias("n"))


def _with_sites(
    asked: DataFrame, listed: DataFrame, keys: list[str], longest: int
) -> DataFrame:
    """Questions joined with the sites of their sub-cell.

    Sites of long sub-cells match nothing here but would still be shuffled to one place; when
    there are any that crowded, the join salts them.
    """
    if longest <= grid.CROWDED_ROWS:
        return asked.join(listed, keys)
    return grid.spread_join(
        listed, asked, keys, F.struct(*[c for c in listed.columns if c not in keys])
    )


def _longest(cells: DataFrame) -> int:
    return cells.agg(F.max("m")).first()[0] or 0


def _around_points(left: DataFrame, right: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Neighbour weight of point sites in each of the cells around their own (own excluded)."""
    offsets = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
            for i in range(-2, 3)
            for j in range(-2, 3)
            if (i, j) != (0, 0)
        ]
    )
    asked = left.select(
        F.col("site").alias("lid"),
        F.col("x").alias("lx"),
        F.col("y").alias("ly"),
        F.col("cx").alias("ox"),
        F.col("cy").alias("oy"),
        F.explode(offsets).alias("o"),
    ).select(
        "lid",
        "lx",
        "ly",
        (F.col("ox") + F.col("o.i")).alias("kx"),
        (F.col("oy") + F.col("o.j")).alias("ky"),
    )
    pairs = asked.join(cells, ["kx", "ky"]).withColumn("cx", F.col("kx")).withColumn("cy", F.col("ky"))
    return _weigh(pairs, right, ["lx", "ly"], eps, _longest(cells))


def _around_cover(
    cells_of: DataFrame, outlines: DataFrame, right: DataFrame, cells: DataFrame, eps: float
) -> DataFrame:
    """Weight of point sites within ``eps`` of each outline, by cell.

    Only cells of the outline's cover (num, cx, cy) and those around them can hold such sites.
    """
    asked = (
        _around(cells_of.select(F.col("num").alias("lid"), "cx", "cy"), own=True)
        .select("lid", F.col("cx").alias("kx"), F.col("cy").alias("ky"))
        .distinct()
    )
    pairs = (
        asked.join(cells, ["kx", "ky"])
        .join(outlines.select(F.col("num").alias("lid"), "segs"), "lid")
        .withColumn("cx", F.col("kx"))
        .withColumn("cy", F.col("ky"))
    )
    return _weigh(pairs, right, ["segs"], eps, _longest(cells))


def _around(placed: DataFrame, own: bool = False) -> DataFrame:
    """Rows repeated for the cells around their own, which stays in (ox, oy)."""
    offsets = [
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
        for i in range(-2, 3)
        for j in range(-2, 3)
        if own or (i, j) != (0, 0)
    ]
    moved = placed.withColumnsRenamed({"cx": "ox", "cy": "oy"}).withColumn("_o", F.explode(F.array(*offsets)))
    return (
        moved.withColumn("cx", F.col("ox") + F.col("_o.i"))
        .withColumn("cy", F.col("oy") + F.col("_o.j"))
        .drop("_o")
    )


def _gap2(a: list[str], b: list[str]) -> Column:
    """Squared distance of two segments that do not cross, given the names of their ends."""

    def to(e, x, y):
        return geometry.segment_distance2(dict(zip(cover.ENDS, map(F.col, e))), F.col(x), F.col(y))

    return F.least(to(a, b[0], b[1]), to(a, b[2], b[3]), to(b, a[0], a[1]), to(b, a[2], a[3]))


LEFT_ENDS = [f"l{c}" for c in cover.ENDS]


def _close_pieces(left: DataFrame, pieces: DataFrame, eps: float) -> DataFrame:
    """(lid, ox, oy, num, w): pieces of outlines within ``eps`` of a left piece of another cell.

    Both sides are (cx, cy, x1, y1, x2, y2) rows, the left ones with a ``lid``. Callers keep one side thin, so a row
    meets fewer than ``min_points`` others per cell around it.
    """
    asked = _around(left.select("lid", "cx", "cy", *[F.col(c).alias(f"l{c}") for c in cover.ENDS]))
    met = grid.spread_join(
        pieces.select("num", "w", "cx", "cy", *cover.ENDS), asked, ["cx", "cy"], F.struct("num", *cover.ENDS)
    )
    return met.where(_gap2(LEFT_ENDS, cover.ENDS) <= F.lit(eps * eps)).select("lid", "ox", "oy", "num", "w")


def _as_pieces(points: DataFrame, *extra) -> DataFrame:
    """Point sites as pieces of no length."""
    x, y = F.col("x"), F.col("y")
    return points.select(*extra, "cx", "cy", x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"))


# --- cells against cells, shapes against shapes ------------------------------------------------


def _cell_links(core: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Pairs of cells (ax, ay, bx, by) with core sites within ``eps`` of each other.

    One row per linked pair of cells, found by box pairs rather than site pairs.
    """
    reach = F.lit(float(eps))
    half = [(i, j) for i in range(0, 3) for j in range(-2, 3) if i > 0 or j > 0]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in half])
    a_side = cells.select(
        F.col("kx").alias("akx"), F.col("ky").alias("aky"), F.col("m").alias("am"),
        *[F.col(c).alias(f"a{c}") for c in BOX], F.explode(offsets).alias("o"),
    ).select(
        "*", (F.col("akx") + F.col("o.i")).alias("kx"), (F.col("aky") + F.col("o.j")).alias("ky")
    )
    pairs = a_side.join(cells.drop("n"), ["kx", "ky"]).select(
        F.col("akx").alias("ax"), F.col("aky").alias("ay"),
        F.col("kx").alias("bx"), F.col("ky").alias("by"),
        "akx", "aky", "am", *[f"a{c}" for c in BOX], "kx", "ky", "m", *BOX,
    )
    zero = F.lit(0.0)

    def span(pick, lo, hi, alo, ahi):
        return pick(F.col(lo) - F.col(ahi), F.col(alo) - F.col(hi))

    near = geometry.point_distance(
        F.greatest(zero, span(F.greatest, "minx", "maxx", "aminx", "amaxx")),
        F.greatest(zero, span(F.greatest, "miny", "maxy", "aminy", "amaxy")), zero, zero,
    )
    far = geometry.point_distance(
        F.greatest(F.col("maxx") - F.col("aminx"), F.col("amaxx") - F.col("minx")),
        F.greatest(F.col("maxy") - F.col("aminy"), F.col("amaxy") - F.col("miny")), zero, zero,
    )
    link = ["ax", "ay", "bx", "by"]
    longest = _longest(cells)
    found = []
    bits = 0
    while True:
        judged = grid.computed(pairs, near=near, far=far).where(F.col("near") <= reach)
        found.append(judged.where(F.col("far") <= reach).select(*link))
        opened = judged.where(F.col("far") > reach)
        last = longest <= SHORT or bits + STEP_BITS > MAX_BITS
        small = F.col("am") * F.col("m") <= SHORT * SHORT
        short = opened if last else opened.where(small)
        listed = core.select(*_sub_cell(bits), "x", "y")
        mine = listed.select(
            F.col("kx").alias("akx"), F.col("ky").alias("aky"),
            F.col("x").alias("axx"), F.col("y").alias("ayy"),
        )
        asked = short.select(*link, "akx", "aky", "kx", "ky")
        met = _with_sites(
            _with_sites(asked, mine, ["akx", "aky"], longest), listed, ["kx", "ky"], longest
        ).where(
            geometry.point_distance(F.col("axx"), F.col("ayy"), F.col("x"), F.col("y")) <= reach
        )
        found.append(met.select(*link))
        if last:
            break
        settled = materialised(_union(found).distinct(), "links")
        found = [settled]
        heavy = materialised(
            opened.where(~small)
            .select(*link, "akx", "aky", "kx", "ky")
            .join(settled, link, "left_anti"),
            "open",
        )
        if heavy.isEmpty():
            break
        finer = materialised(
            _children(
                core,
                bits,
                heavy.select("kx", "ky").unionByName(
                    heavy.select(F.col("akx").alias("kx"), F.col("aky").alias("ky"))
                ),
            ).drop("n"),
            "boxes",
        )
        longest = finer.agg(F.max("m")).first()[0]
        finer_a = finer.select(
            F.col("kx").alias("akx"), F.col("ky").alias("aky"), F.col("jx").alias("ajx"),
            F.col("jy").alias("ajy"), F.col("m").alias("am"), *[F.col(c).alias(f"a{c}") for c in BOX],
        )
        pairs = (
            heavy.join(finer_a, ["akx", "aky"])
            .join(finer, ["kx", "ky"])
            .drop("kx", "ky", "akx", "aky")
            .withColumnsRenamed({"jx": "kx", "jy": "ky", "ajx": "akx", "ajy": "aky"})
        )
        bits += STEP_BITS
    return _union(found).distinct()


def _piece_links(pairs: DataFrame, items: DataFrame, eps: float, side: float) -> DataFrame:
    """Edges (u, v) for pairs of cells with items, points or pieces of outlines, within ``eps`` of each other.

    ``pairs`` holds u, v and the two cells (ax, ay) and (bx, by). As for points, tight boxes answer most; where both
    cells hold many items, they are cut to sub-cells and asked again.
    """
    reach = F.lit(float(eps))
    zero = F.lit(0.0)
    found: list[DataFrame] = []
    bits = 0

    def span(lo, hi):
        return F.greatest(zero, F.col(f"b{lo}") - F.col(f"a{hi}"), F.col(f"a{lo}") - F.col(f"b{hi}"))

    near = geometry.point_distance(span("minx", "maxx"), span("miny", "maxy"), zero, zero)
    far = geometry.point_distance(
        F.greatest(F.col("bmaxx") - F.col("aminx"), F.col("amaxx") - F.col("bminx")),
        F.greatest(F.col("bmaxy") - F.col("aminy"), F.col("amaxy") - F.col("bminy")), zero, zero,
    )
    while True:
        boxes = materialised(
            items.groupBy("cx", "cy").agg(
                F.count("*").alias("m"),
                F.min(F.least("x1", "x2")).alias("minx"),
                F.min(F.least("y1", "y2")).alias("miny"),
                F.max(F.greatest("x1", "x2")).alias("maxx"),
                F.max(F.greatest("y1", "y2")).alias("maxy"),
            ),
            "boxes",
        )

        def sided(frame, name):
            return frame.withColumnsRenamed({c: name + c.removeprefix("c") for c in frame.columns})

        judged = pairs.join(sided(boxes, "a"), ["ax", "ay"]).join(sided(boxes, "b"), ["bx", "by"])
        judged = grid.computed(judged, near=near, far=far).where(F.col("near") <= reach)
        judged = materialised(judged.select("u", "v", "ax", "ay", "bx", "by", "am", "bm", "far"), "judged")
        found.append(judged.where(F.col("far") <= reach).select("u", "v"))
        last = bits + STEP_BITS > MAX_BITS
        few = F.lit(True) if last else F.col("am") * F.col("bm") <= SHORT * SHORT
        opened = judged.where(F.col("far") > reach)
        a_side = items.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), *[F.col(c).alias(f"l{c}") for c in cover.ENDS])
        met = (
            opened.where(few).select("u", "v", "ax", "ay", "bx", "by")
            .join(a_side, ["ax", "ay"])
            .join(items.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), *cover.ENDS), ["bx", "by"])
            .where(_gap2(LEFT_ENDS, cover.ENDS) <= F.lit(eps * eps))
        )
        settled = materialised(_union([*found, met.select("u", "v")]).distinct(), "links")
        found = [settled]
        if last:
            break
        heavy = materialised(
            opened.where(~few).join(settled, ["u", "v"], "left_anti").select("u", "v", "ax", "ay", "bx", "by"), "open"
        )
        if heavy.isEmpty():
            break
        bits += STEP_BITS
        asked = heavy.select(F.col("ax").alias("px"), F.col("ay").alias("py")).unionByName(
            heavy.select(F.col("bx").alias("px"), F.col("by").alias("py"))
        ).distinct()
        up = [F.shiftright("cx", STEP_BITS).alias("px"), F.shiftright("cy", STEP_BITS).alias("py")]
        finer = cover.cut(items.select(*cover.ENDS), side / 2**bits).select("*", *up)
        items = materialised(finer.join(asked, ["px", "py"], "left_semi"), "items")
        children = items.select("px", "py", "cx", "cy").distinct()
        pairs = heavy.join(
            children.toDF("ax", "ay", "jx", "jy"), ["ax", "ay"]
        ).join(children.toDF("bx", "by", "hx", "hy"), ["bx", "by"]).select(
            "u", "v", F.col("jx").alias("ax"), F.col("jy").alias("ay"), F.col("hx").alias("bx"), F.col("hy").alias("by")
        )
        items = items.drop("px", "py")
    return settled


# --- sites -------------------------------------------------------------------------------------


def _measures() -> list[Column]:
    return [
        F.min("id").alias("site"),
        F.count("*").alias("w"),
        F.max("severity").alias("top"),
        F.min("starts_at").alias("first_at"),
        F.max("starts_at").alias("last_at"),
    ]


def _point_sites(events: DataFrame, side: float) -> DataFrame:
    first = F.col("geom")["parts"][0][0][0]
    places = (
        events.where(geometry.is_point(F.col("geom")))
        .select("id", "severity", "starts_at", first["x"].alias("lon"), first["y"].alias("lat"))
        .groupBy("lon", "lat")
        .agg(*_measures())
    )
    s = F.lit(side)
    metric = grid.computed(places, p=projection.to_metres(F.col("lon"), F.col("lat")))
    return metric.select(
        "site", "w", "top", "first_at", "last_at", "lon", "lat",
        F.col("p.x").alias("x"), F.col("p.y").alias("y"),
        (F.col("p.x") / s).alias("u"), (F.col("p.y") / s).alias("v"),
        F.floor(F.col("p.x") / s).cast("bigint").alias("cx"),
        F.floor(F.col("p.y") / s).cast("bigint").alias("cy"),
    )


# Sorting by a nested outline compares corner by corner; a hash before it settles all but equal ones.
OUTLINE = ["_hash", "parts"]


def _outline_key() -> list[Column]:
    return [F.xxhash64("geom.parts").alias("_hash"), F.col("geom.parts").alias("parts")]


def _shape_sites(events: DataFrame) -> DataFrame:
    outlines = (
        events.where(~geometry.is_point(F.col("geom")))
        .select("id", "severity", "starts_at", *_outline_key())
        .groupBy(*OUTLINE)
        .agg(*_measures())
        .drop("_hash")
    )
    placed = grid.computed(
        outlines, mparts=F.transform("parts", lambda p: F.transform(p, projection.ring_to_metres))
    )
    flat = F.flatten(F.flatten(F.col("mparts")))
    xs, ys = F.transform(flat, lambda v: v["x"]), F.transform(flat, lambda v: v["y"])
    return grid.computed(
        placed,
        segs=geometry.edges_of_parts(F.col("mparts")),
        moments=geometry.moments_of_parts(F.col("mparts")),
        minx=F.array_min(xs),
        miny=F.array_min(ys),
        maxx=F.array_max(xs),
        maxy=F.array_max(ys),
        # written right away, so a number stays with its outline
        num=F.monotonically_increasing_id(),
    ).drop("mparts")


# --- the operator ------------------------------------------------------------------------------


class _Outlines:
    """The outlines of a run on the grid, by number: their pieces per cell and their cover."""

    def __init__(self, shapes: DataFrame, cells: DataFrame, side: float):
        segments = shapes.select("num", "w", F.inline("segs"))
        self.pieces = materialised(cover.cut(segments, side), "pieces")
        met = materialised(self.pieces.select("num", "w", "cx", "cy").distinct(), "met")
        points = cells.select(F.col("kx").alias("cx"), F.col("ky").alias("cy"))
        occupied = materialised(points.unionByName(met.select("cx", "cy")).distinct(), "occupied")
        filled = cover.full_cells(segments, occupied, side, ["num", "w"])
        self.cover = materialised(met.unionByName(filled).distinct(), "cover")

    def of(self, some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pieces, cover) of some outlines."""
        return tuple(f.join(some.select("num"), "num", "left_semi") for f in (self.pieces, self.cover))


def _others(near: DataFrame) -> DataFrame:
    """(lid, n): weight of the distinct outlines near each left object."""
    return near.select("lid", "num", "w").distinct().groupBy("lid").agg(F.sum("w").alias("n"))


def _shape_weights(
    outlines: _Outlines, thin: DataFrame, points: DataFrame, cells: DataFrame, eps: float
) -> DataFrame:
    """(num, n): weight near each outline without a crowded cell, its own not included."""
    pieces, covered = outlines.of(thin)
    by_points = _around_cover(covered, thin, points, cells, eps).select("lid", "n")
    # every cell of a thin outline has fewer than min_points members
    sharing = covered.select(F.col("num").alias("lid"), "cx", "cy").join(outlines.cover, ["cx", "cy"])
    near = _close_pieces(pieces.withColumn("lid", F.col("num")), outlines.pieces, eps)
    both = sharing.select("lid", "num", "w").unionByName(near.select("lid", "num", "w"))
    both = by_points.unionByName(_others(both.where(F.col("lid") != F.col("num"))))
    return both.groupBy(F.col("lid").alias("num")).agg(F.sum("n").alias("others"))


# Cells are numbered below zero, against the order of (cx, cy).
_HALF_GRID = 1 << 30


def _cell_node(cx: Column, cy: Column) -> Column:
    return -((cx + _HALF_GRID) * (2 * _HALF_GRID) + (cy + _HALF_GRID)) - 1


def _cover_links(covered: DataFrame) -> DataFrame:
    """Edges (u, v) between cells that join all cells of an outline: the next one in its row, the first one of its next row.

    Outlines over the same ground give the same edges, so these grow with the cells, not with cells times outlines.
    """
    cells = covered.select("num", "cx", "cy")
    along = Window.partitionBy("num", "cy").orderBy("cx")
    beside = cells.select("cx", "cy", F.lead("cx").over(along).alias("dx"), F.col("cy").alias("dy"))
    up = Window.partitionBy("num").orderBy("cy")
    firsts = cells.groupBy("num", "cy").agg(F.min("cx").alias("cx"))
    above = firsts.select("cx", "cy", F.lead("cx").over(up).alias("dx"), F.lead("cy").over(up).alias("dy"))
    return (
        beside.unionByName(above)
        .where(F.col("dx").isNotNull())
        .distinct()
        .select(_cell_node(F.col("cx"), F.col("cy")).alias("u"), _cell_node(F.col("dx"), F.col("dy")).alias("v"))
    )


def _labelled_sites(events: DataFrame, eps_m: float, min_points: int) -> tuple[DataFrame, DataFrame]:
    """(point sites, shape sites) that belong to a cluster, with its label."""
    eps = float(eps_m)
    # A hair below the exact side keeps the diagonal within eps under rounding.
    side = eps / math.sqrt(2) * (1 - 1e-9)
    points = materialised(_point_sites(events, side), "points")
    shapes = materialised(_shape_sites(events), "shapes")
    cells = materialised(_boxes(points, 0), "cells")
    crowd = cells.select(F.col("kx").alias("cx"), F.col("ky").alias("cy"), F.col("n").alias("own"))
    outlines = None if shapes.isEmpty() else _Outlines(shapes, cells, side)
    if outlines:
        crowd = materialised(
            crowd.unionByName(outlines.cover.select("cx", "cy", F.col("w").alias("own")))
            .groupBy("cx", "cy").agg(F.sum("own").alias("own")),
            "crowd",
        )

    sited = grid.spread_join(points, crowd, ["cx", "cy"], F.col("site"))
    thin = sited.where(F.col("own") < min_points)
    per_cell = _around_points(thin, points, cells, eps)
    neighbours = per_cell.select(F.col("lid").alias("site"), "n")
    if outlines:
        # outlines over the point's own cell are in its weight already
        near = _close_pieces(_as_pieces(thin, F.col("site").alias("lid")), outlines.pieces, eps)
        own = outlines.cover.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), "num")
        beside = _others(near.join(own, ["ox", "oy", "num"], "left_anti"))
        neighbours = neighbours.unionByName(beside.select(F.col("lid").alias("site"), "n"))
    total = neighbours.groupBy("site").agg(F.sum("n").alias("others"))
    core_test = F.col("own") + F.coalesce(F.col("others"), F.lit(0)) >= min_points
    judged_thin = thin.join(total, "site", "left").withColumn("core", core_test).drop("others")
    judged = materialised(
        sited.where(F.col("own") >= min_points)
        .withColumn("core", F.lit(True))
        .unionByName(judged_thin)
        .drop("own"),
        "judged",
    )
    core = judged.where("core")
    loose = judged.where(~F.col("core"))
    core_cells = materialised(_boxes(core, 0), "cells")
    own_node = _cell_node(F.col("cx"), F.col("cy"))
    cells_of_core = core_cells.select(F.col("kx").alias("cx"), F.col("ky").alias("cy"))
    edges = _cell_links(core, core_cells, eps).select(
        _cell_node(F.col("ax"), F.col("ay")).alias("u"), _cell_node(F.col("bx"), F.col("by")).alias("v")
    )
    loose_shapes = None
    if outlines:
        heavy = outlines.cover.join(crowd.where(F.col("own") >= min_points), ["cx", "cy"], "left_semi")
        sure = materialised(heavy.select("num").distinct(), "heavy")
        thin_shapes = materialised(shapes.join(sure, "num", "left_anti"), "thin")
        core_pieces, core_cover, core_shapes = outlines.pieces, outlines.cover, shapes
        # without thin outlines all are core, and there is nothing to count
        if not thin_shapes.isEmpty():
            weights = _shape_weights(outlines, thin_shapes, points, cells, eps)
            core_test = F.col("w") + F.coalesce(F.col("others"), F.lit(0)) >= min_points
            counted = thin_shapes.join(weights, "num", "left")
            loose_shapes = materialised(counted.where(~core_test).drop("others"), "loose")
            core_shapes = shapes.join(loose_shapes, "num", "left_anti")
            core_pieces, core_cover = (materialised(f, "core") for f in outlines.of(core_shapes))
        cells_of_core = cells_of_core.unionByName(core_cover.select("cx", "cy")).distinct()
        # one outline over several cells makes them one
        edges = edges.unionByName(_cover_links(core_cover))
    linked = components(edges, write_halves=True)
    cells_of_core = cells_of_core.withColumn("node", own_node)
    groups = cells_of_core.join(linked, "node", "left").select("cx", "cy", F.coalesce("label", "node").alias("piece"))
    groups = materialised(groups, "groups")
    if outlines:
        groups = _joined_over_gaps(groups, core, core_pieces, eps, side)
    # a cluster is named by the smallest id of its core members
    named = grid.spread_join(core.select("cx", "cy", "site"), groups, ["cx", "cy"], F.col("site")).select("piece", "site")
    if outlines:
        # any cell of an outline tells its cluster
        first = core_cover.groupBy("num").agg(F.max(own_node).alias("node"))
        placed = first.join(groups.select(own_node.alias("node"), "piece"), "node").join(core_shapes.select("num", "site"), "num")
        placed = materialised(placed.select("num", "site", "piece"), "placed")
        named = named.unionByName(placed.select("piece", "site"))
    names = materialised(named.groupBy("piece").agg(F.min("site").alias("label")), "names")
    cell_label = materialised(groups.join(names, "piece").select("cx", "cy", "label"), "labels")

    carried = ["site", "w", "top", "first_at", "last_at", "lon", "lat", "x", "y"]
    inner = grid.spread_join(core, cell_label, ["cx", "cy"], F.col("site")).select(*carried, "label")
    homes = [
        _around_points(loose, core, core_cells, eps)
        .select(F.col("lid").alias("site"), "cx", "cy")
        .unionByName(loose.select("site", "cx", "cy"))
        .join(cell_label, ["cx", "cy"])
        .select("site", "label")
    ]
    shape_members = None
    if outlines:
        shape_label = placed.join(names, "piece").select("num", "label")

        def home(near):
            return near.join(shape_label, "num").select("lid", "label")

        near = _close_pieces(_as_pieces(loose, F.col("site").alias("lid")), core_pieces, eps)
        homes.append(home(near).select(F.col("lid").alias("site"), "label"))
        shape_homes = shape_label
        if loose_shapes is not None:
            pieces, covered = outlines.of(loose_shapes)
            reached = _around_cover(covered, loose_shapes, core, core_cells, eps).select(
                F.col("lid").alias("num"), "cx", "cy"
            )
            by_cell = reached.unionByName(covered.select("num", "cx", "cy")).join(cell_label, ["cx", "cy"])
            by_piece = home(_close_pieces(pieces.withColumn("lid", F.col("num")), core_pieces, eps))
            found = by_cell.select("num", "label").unionByName(by_piece.select(F.col("lid").alias("num"), "label"))
            shape_homes = shape_homes.unionByName(found.groupBy("num").agg(F.min("label").alias("label")))
        shape_members = shapes.drop("segs").join(shape_homes, "num")
    border = loose.join(
        _union(homes).groupBy("site").agg(F.min("label").alias("label")), "site"
    ).select(*carried, "label")
    return inner.unionByName(border), shape_members


def _joined_over_gaps(
    groups: DataFrame, core: DataFrame, core_pieces: DataFrame, eps: float, side: float
) -> DataFrame:
    """Groups of cells after joining those whose outlines come within ``eps`` of other cells' members.

    Only cells around a piece whose group differs from its own are looked at.
    """
    edged = core_pieces.select("cx", "cy").distinct().join(groups, ["cx", "cy"])
    pairs = (
        _around(edged.withColumnRenamed("piece", "u"))
        .join(groups.withColumnRenamed("piece", "v"), ["cx", "cy"])
        .where(F.col("u") != F.col("v"))
        .select("u", "v", F.col("ox").alias("ax"), F.col("oy").alias("ay"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    )
    pairs = materialised(pairs, "pairs")
    if pairs.isEmpty():
        return groups
    wanted = pairs.select(F.col("ax").alias("cx"), F.col("ay").alias("cy")).unionByName(
        pairs.select(F.col("bx").alias("cx"), F.col("by").alias("cy"))
    ).distinct()
    items = _as_pieces(core).unionByName(core_pieces.select("cx", "cy", *cover.ENDS))
    items = materialised(items.join(wanted, ["cx", "cy"], "left_semi"), "items")
    links = _piece_links(pairs, items, eps, side)
    if links.isEmpty():
        return groups
    renamed = components(links).select(F.col("node").alias("piece"), F.col("label").alias("_whole"))
    joined = groups.join(renamed, "piece", "left").select("cx", "cy", F.coalesce("_whole", "piece").alias("piece"))
    return materialised(joined, "groups")


def _checked(events: DataFrame, eps_m: float, min_points: int, filters: dict) -> DataFrame:
    checks.metres(eps_m, "eps_m")
    checks.min_points(min_points)
    checks.cluster_bound(filters)
    return apply_filters(events, **filters).select("id", "geom", "severity", "starts_at")


def dbscan_labels(events: DataFrame, *, eps_m: float, min_points: int, **filters) -> DataFrame:
    """(id, cluster): clustered events with the smallest core member id of their cluster.

    An event counts itself among its neighbours and one at exactly ``eps_m`` is a neighbour. A
    border event belongs to the reachable cluster of the smallest label. Noise is left out.
    """
    chosen = _checked(events, eps_m, min_points, filters)
    points, shapes = _labelled_sites(chosen, eps_m, min_points)
    first = F.col("geom")["parts"][0][0][0]
    spots = chosen.where(geometry.is_point(F.col("geom"))).select(
        "id", first["x"].alias("lon"), first["y"].alias("lat")
    )
    out = grid.spread_join(
        spots, points.select("lon", "lat", "label"), ["lon", "lat"], F.col("id")
    ).select("id", F.col("label").alias("cluster"))
    if shapes is None:
        return out
    outlines = chosen.where(~geometry.is_point(F.col("geom"))).select("id", *_outline_key())
    labelled = shapes.select(F.xxhash64("parts").alias("_hash"), "parts", "label")
    return out.unionByName(
        grid.spread_join(outlines, labelled, OUTLINE, F.col("id")).select("id", F.col("label").alias("cluster"))
    )


def cluster_summary(
    events: DataFrame, *, eps_m: float, min_points: int, limit: int | None = None, **filters
) -> DataFrame:
    """Size, severity, time range and centroid of all clusters, or of the ``limit`` largest.

    Everything is summed per site beforehand, so no event row is joined again. The centroid is
    taken in metres and given in degrees; where a cluster has any area, only areas weigh.
    Clusters are numbered from 0 in result order: largest first, then by smallest core member.
    """
    chosen = _checked(events, eps_m, min_points, filters)
    points, shapes = _labelled_sites(chosen, eps_m, min_points)
    w = F.col("w")
    zero = F.lit(0.0)
    base = ["label", "w", "top", "first_at", "last_at"]
    sums = points.select(
        *base, (w * F.col("x")).alias("px"), (w * F.col("y")).alias("py"), w.alias("pw"),
        zero.alias("ax"), zero.alias("ay"), zero.alias("aw"),
    )
    if shapes is not None:
        m = F.col("moments")
        sums = sums.unionByName(
            shapes.select(
                *base, zero.alias("px"), zero.alias("py"), F.lit(0).cast("bigint").alias("pw"),
                (w * m["mx"]).alias("ax"), (w * m["my"]).alias("ay"), (w * m["a"]).alias("aw"),
            )
        )
    grouped = sums.groupBy("label").agg(
        F.sum("w").alias("count"),
        F.max("top").alias("max_severity"),
        F.min("first_at").alias("first_starts_at"),
        F.max("last_at").alias("last_starts_at"),
        *[F.sum(c).alias(c) for c in ("px", "py", "pw", "ax", "ay", "aw")],
    )
    largest = grouped.orderBy(F.col("count").desc(), "label")
    if limit is not None:
        largest = largest.limit(limit)
    areal = F.col("aw") > 0
    centre = projection.to_degrees(
        F.when(areal, F.try_divide("ax", "aw")).otherwise(F.try_divide("px", "pw")),
        F.when(areal, F.try_divide("ay", "aw")).otherwise(F.try_divide("py", "pw")),
    )
    # The ids of the written rows hold the sorted partition and the place in it.
    place = materialised(grid.computed(largest, c=centre).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    sizes = place.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        place.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(
            "cluster_id", (F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).cast("int")
        )
        .select(
            "cluster_id",
            F.col("label").alias("cluster"),
            "count",
            "max_severity",
            "first_starts_at",
            "last_starts_at",
            F.col("c.x").alias("lon"),
            F.col("c.y").alias("lat"),
        )
        .orderBy("cluster_id")
    )
