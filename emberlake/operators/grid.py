"""Grid cells as equi-join keys for spatial joins, with salting of crowded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.session import materialised

# A cell with more rows than this is split over several join keys.
CROWDED_ROWS = 1_000_000


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-row generator.

    A plain projection lets the optimizer copy an expensive expression into every filter and
    inferred null check above it. Nothing is pushed below a generator, so each value is computed
    once per row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def cell_of(x: Column, y: Column, side: float) -> list[Column]:
    """Integer cell columns (cx, cy) of a position."""
    return [
        F.floor(x / F.lit(side)).cast("bigint").alias("cx"),
        F.floor(y / F.lit(side)).cast("bigint").alias("cy"),
    ]


def explode_cells(
    df: DataFrame, minx: Column, miny: Column, maxx: Column, maxy: Column, side: float
) -> DataFrame:
    """One row per grid cell the box touches."""

    def span(lo, hi):
        return F.sequence(
            F.floor(lo / F.lit(side)).cast("bigint"), F.floor(hi / F.lit(side)).cast("bigint")
        )

    return df.withColumn("cx", F.explode(span(minx, maxx))).withColumn(
        "cy", F.explode(span(miny, maxy))
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's own size estimate stays below the broadcast threshold.

    The estimate is only good for stored tables and what filters and aggregates leave of them: the planner
    does not know how many rows a generator makes.
    """
    spark = df.sparkSession
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    threshold = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(limit))
    if threshold < 0:
        return False
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= threshold


def spread_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    spread: Column,
) -> DataFrame:
    """Inner equi-join that keeps a crowded key from landing in one task.

    A small ``few`` side is broadcast and nothing is shuffled; a generated one is written first, so that its size is
    known. Otherwise each crowded key of
    ``many`` is split into salts by ``spread`` and its ``few`` rows are repeated once per salt.
    The table of crowded keys has at most rows / CROWDED_ROWS entries, which bounds its broadcast.
    Adaptive execution does not split a join whose side is the output of an aggregate on the same
    key, so this does not lean on it.
    """
    if "Generate" in few._jdf.queryExecution().optimizedPlan().toString():
        few = materialised(few, "few")
    if fits_broadcast(few):
        return many.join(F.broadcast(few), keys)
    crowded = (
        many.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > CROWDED_ROWS)
        .select(*keys, F.ceil(F.col("_n") / F.lit(CROWDED_ROWS)).cast("int").alias("_salts"))
    )
    one = F.coalesce(F.col("_salts"), F.lit(1))
    crowded = F.broadcast(crowded)
    left = many.join(crowded, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread), one).cast("int")
    )
    right = few.join(crowded, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), one - 1))
    )
    return left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"]).drop("_salt")


def join_on_cell(many: DataFrame, few: DataFrame, spread: Column) -> DataFrame:
    """``spread_join`` on (cx, cy): a cell with a large share of all rows is split."""
    return spread_join(many, few, ["cx", "cy"], spread)
