"""The cells of a square grid that segments and the areas they bound meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.operators import grid

ENDS = ["x1", "y1", "x2", "y2"]
# Runs of full cells are filed in blocks of 64 columns.
BLOCK_BITS = 6


def _cells_between(a: Column, b: Column, side: Column) -> Column:
    return F.sequence(
        F.floor(F.least(a, b) / side).cast("bigint"), F.floor(F.greatest(a, b) / side).cast("bigint")
    )


def _stretch(a: Column, b: Column, cell: Column, side: Column) -> tuple[Column, Column]:
    """Where a segment from a to b along one axis enters and leaves a cell; all of it if it is level."""
    enter, leave = F.try_divide(cell * side - a, b - a), F.try_divide((cell + 1) * side - a, b - a)
    # greatest and least pass over the nulls of a level segment
    return F.greatest(F.lit(0.0), F.least(enter, leave)), F.least(F.lit(1.0), F.greatest(enter, leave))


def cut(segments: DataFrame, side: float) -> DataFrame:
    """Segments (x1, y1, x2, y2) cut at the grid lines: one row per segment and cell (cx, cy) it meets.

    Other columns are carried along; a segment of no length stays one row.
    """
    s = F.lit(float(side))
    others = [c for c in segments.columns if c not in ENDS]
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    rows = segments.withColumn("cy", F.explode(_cells_between(y1, y2, s)))
    t0, t1 = _stretch(y1, y2, F.col("cy"), s)
    rows = grid.computed(rows, t0=t0, t1=F.greatest(t0, t1))
    cells = rows.withColumn(
        "cx", F.explode(_cells_between(x1 + F.col("t0") * (x2 - x1), x1 + F.col("t1") * (x2 - x1), s))
    )
    u0, u1 = _stretch(x1, x2, F.col("cx"), s)
    begin, end = F.greatest(F.col("t0"), u0), F.least(F.col("t1"), u1)
    pieces = grid.computed(cells, u0=begin, u1=F.greatest(begin, end))
    u0, u1 = F.col("u0"), F.col("u1")
    return pieces.select(
        *others,
        "cx",
        "cy",
        (x1 + u0 * (x2 - x1)).alias("x1"),
        (y1 + u0 * (y2 - y1)).alias("y1"),
        F.when(u1 == 1, x2).otherwise(x1 + u1 * (x2 - x1)).alias("x2"),
        F.when(u1 == 1, y2).otherwise(y1 + u1 * (y2 - y1)).alias("y2"),
    )


def full_cells(segments: DataFrame, occupied: DataFrame, side: float, keys: list[str]) -> DataFrame:
    """(keys, cx, cy): the cells of ``occupied`` whose centre is inside the area of a key's segments.

    The even-odd rule along the centre line of each row of cells gives runs of cells; a row's crossings of one outline
    are sorted in one place, and runs are only opened where an occupied cell lies in them. A cell that no segment of
    the key meets is either full or empty, so its centre speaks for it.
    """
    s = F.lit(float(side))
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    first = F.ceil(F.least(y1, y2) / s - 0.5).cast("bigint")
    last = F.ceil(F.greatest(y1, y2) / s - 0.5).cast("bigint") - 1
    rows = segments.where(last >= first).withColumn("cy", F.explode(F.sequence(first, last)))
    level = (F.col("cy") + 0.5) * s
    crossings = (
        rows.select(*keys, "cy", (x1 + (level - y1) / (y2 - y1) * (x2 - x1)).alias("x"))
        .groupBy(*keys, "cy")
        .agg(F.sort_array(F.collect_list("x")).alias("xs"))
    )
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("xs") - 2), lambda i: i % 2 == 0),
        lambda i: F.struct(
            F.ceil(F.get("xs", i) / s - 0.5).cast("bigint").alias("a"),
            F.floor(F.get("xs", i + 1) / s - 0.5).cast("bigint").alias("b"),
        ),
    )
    runs = crossings.where(F.size("xs") >= 2).select(*keys, "cy", F.inline(pairs)).where("a <= b")
    filed = runs.withColumn(
        "bx", F.explode(F.sequence(F.shiftright("a", BLOCK_BITS), F.shiftright("b", BLOCK_BITS)))
    )
    cells = occupied.select("cx", "cy", F.shiftright("cx", BLOCK_BITS).alias("bx"))
    met = grid.spread_join(filed, cells, ["cy", "bx"], F.struct(*keys))
    return met.where(F.col("cx").between(F.col("a"), F.col("b"))).select(*keys, "cx", "cy")
