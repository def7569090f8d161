"""Point-in-polygon join of event centroids with an area table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions import geometry
from emberlake.operators import grid

CELL_DEG = 0.25
# rows of cells whose segments are gathered first
STRIP_ROWS = 16


def area_cells(areas: DataFrame, key_columns: list[str], side: float = CELL_DEG) -> DataFrame:
    """Per area and touched cell, what a position in that cell still has to be tested against.

    ``near_edges`` is NULL where the whole cell lies inside the area. Otherwise it keeps the
    segments that can meet a ray to +x from somewhere in the cell, which is all the even-odd rule
    and the boundary test need. Cells wholly outside are dropped.
    """
    # Slack of a millionth of a cell keeps rounding in the cell bounds from losing a segment.
    slack = F.lit(side * 1e-6)

    def index(of):
        return F.floor(of / F.lit(side)).cast("bigint")

    def within_rows(segments, first, last):
        """The segments that meet the rows ``first`` to ``last`` of cells."""
        low, high = first * F.lit(side) - slack, (last + 1) * F.lit(side) + slack
        return F.filter(segments, lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high))

    # From the outline to strips of rows, to rows, to cells: each list is cut from the one above it, never from the outline.
    strips = areas.select(*key_columns, "geom").select(
        *key_columns,
        index(F.col("geom.minx")).alias("left"),
        index(F.col("geom.maxx")).alias("right"),
        index(F.col("geom.maxy")).alias("top"),
        F.explode(F.sequence(index(F.col("geom.miny")), index(F.col("geom.maxy")), F.lit(STRIP_ROWS).cast("bigint"))).alias("low"),
        "geom",
    )
    strips = strips.withColumn("high", F.least("top", F.col("low") + STRIP_ROWS - 1))
    strips = grid.computed(strips, strip=within_rows(geometry.edges(F.col("geom")), F.col("low"), F.col("high"))).drop("geom")
    lines = strips.withColumn("cy", F.explode(F.sequence("low", "high")))
    lines = grid.computed(lines, line=within_rows(F.col("strip"), F.col("cy"), F.col("cy"))).drop("strip")
    cells = lines.withColumn("cx", F.explode(F.sequence("left", "right")))
    x0, y0 = F.col("cx") * F.lit(side), F.col("cy") * F.lit(side)
    x1, y1 = (F.col("cx") + 1) * F.lit(side), (F.col("cy") + 1) * F.lit(side)
    band = F.filter("line", lambda e: F.greatest(e["x1"], e["x2"]) >= x0 - slack)
    cells = grid.computed(cells.select(*key_columns, "line", "cx", "cy"), band=band, x0=x0, y0=y0, x1=x1, y1=y1)
    touched = F.exists("band", lambda e: F.least(e["x1"], e["x2"]) <= F.col("x1") + slack)
    centre_in = geometry.odd_crossings(
        F.col("band"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    )
    return cells.where(touched | centre_in).select(
        *key_columns, "cx", "cy", F.when(touched, F.col("band")).alias("near_edges")
    )


def join_within(
    events: DataFrame,
    areas: DataFrame,
    keep: list[str] | None = None,
    side: float = CELL_DEG,
) -> DataFrame:
    """Inner join: the event's centroid lies strictly within the area.

    An equi-join on the centroid's grid cell with the exact test as the residual condition; a
    position on a boundary matches nothing. Result: id, ``keep``, and the area's columns.
    """
    keep = keep or []
    area_columns = [c for c in areas.columns if c != "geom"]
    located = grid.computed(
        events.select("id", *keep, "geom"), c=geometry.centroid(F.col("geom"))
    )
    located = located.select("id", *keep, "c", *grid.cell_of(F.col("c.x"), F.col("c.y"), side))
    pairs = grid.join_on_cell(located, area_cells(areas, area_columns, side), F.col("id"))
    inside = F.col("near_edges").isNull() | geometry.strictly_inside(
        F.col("near_edges"), F.col("c.x"), F.col("c.y")
    )
    return pairs.where(inside).select("id", *keep, *area_columns)
