"""The three analytical reports and the per-source count."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions import values
from emberlake.operators import checks
from emberlake.operators.spatial_join import join_within


def in_year(column: str, year: int) -> Column:
    """Calendar year as a half-open range of instants, which the scan can prune on."""
    checks.year(year)
    start = dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc)
    end = dt.datetime(year + 1, 1, 1, tzinfo=dt.timezone.utc)
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def burned_area_by_month(
    events: DataFrame, provinces: DataFrame, *, year: int, province_code: str | None = None
) -> DataFrame:
    """Burnt areas per province and month. A fire counts once, where its centroid lies."""
    checks.province_code(province_code)
    fires = (
        events.where((F.col("hazard_type") == "wildfire") & in_year("starts_at", year))
        .where(values.attr(F.col("attrs"), "kind") == "burnt_area")
        .select(
            "id",
            "geom",
            F.month("starts_at").alias("month"),
            values.attr_double(F.col("attrs"), "area_ha").alias("area_ha"),
        )
    )
    if province_code is not None:
        provinces = provinces.where(F.col("province_code") == province_code)
    placed = join_within(fires, provinces, keep=["month", "area_ha"])
    return (
        placed.groupBy("province_code", F.col("name").alias("province"), "month")
        .agg(
            F.count("*").alias("events"),
            F.round(F.sum("area_ha"), 1).alias("burned_area_ha"),
        )
        .orderBy("province_code", "month")
    )


def quake_frequency(
    events: DataFrame, *, year: int, min_magnitude: float | None = None
) -> DataFrame:
    """Earthquakes per month with the strongest one. Without a magnitude there is no match, even
    when no minimum is asked for."""
    checks.min_magnitude(min_magnitude)
    magnitude = values.attr_double(F.col("attrs"), "magnitude")
    return (
        events.where((F.col("hazard_type") == "earthquake") & in_year("starts_at", year))
        .select(F.month("starts_at").alias("month"), magnitude.alias("magnitude"))
        .where(F.col("magnitude") >= F.lit(float(min_magnitude or 0.0)))
        .groupBy("month")
        .agg(F.count("*").alias("events"), F.max("magnitude").alias("max_magnitude"))
        .orderBy("month")
    )


def warnings_summary(
    events: DataFrame,
    *,
    year: int,
    phenomenon_code: str | None = None,
    approximate_zones: bool = False,
) -> DataFrame:
    """Warnings and distinct zones per phenomenon and level.

    Counting per (phenomenon, level, zone) first keeps the distinct count exact and spreads the
    few result groups over their zones, so that no group is gathered in one task.
    """
    checks.phenomenon_code(phenomenon_code)
    attrs = F.col("attrs")
    rows = events.where(
        (F.col("hazard_type") == "weather_warning") & in_year("starts_at", year)
    ).select(
        values.attr(attrs, "phenomenon").alias("phenomenon"),
        values.attr(attrs, "level").alias("level"),
        values.attr(attrs, "zone").alias("zone"),
    )
    if phenomenon_code is not None:
        rows = rows.where(values.phenomenon_code(F.col("phenomenon")) == phenomenon_code)
    if approximate_zones:
        out = rows.groupBy("phenomenon", "level").agg(
            F.count("*").alias("warnings"), F.approx_count_distinct("zone").alias("zones")
        )
    else:
        per_zone = rows.groupBy("phenomenon", "level", "zone").agg(F.count("*").alias("n"))
        out = per_zone.groupBy("phenomenon", "level").agg(
            F.sum("n").alias("warnings"), F.count("zone").alias("zones")
        )
    return out.orderBy("phenomenon", "level")


def count_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("events"))


def plane_parity(events: DataFrame, report: DataFrame) -> DataFrame:
    """Burnt hectares of the event table next to those of the monthly report.

    They agree when every burnt area lies within some province; each report row may differ by its
    own rounding.
    """
    none = F.lit(None)
    operational = (
        events.where(F.col("hazard_type") == "wildfire")
        .where(values.attr(F.col("attrs"), "kind") == "burnt_area")
        .agg(F.sum(values.attr_double(F.col("attrs"), "area_ha")).alias("operational_ha"))
        .select(
            "operational_ha",
            none.cast("double").alias("analytical_ha"),
            none.cast("bigint").alias("n"),
        )
    )
    analytical = report.agg(
        none.cast("double").alias("operational_ha"),
        F.sum("burned_area_ha").alias("analytical_ha"),
        F.count("*").alias("n"),
    )
    both = operational.unionByName(analytical).agg(
        *[
            F.coalesce(F.max(c), F.lit(0.0)).alias(c)
            for c in ("operational_ha", "analytical_ha")
        ],
        F.max("n").alias("n"),
    )
    slack = F.lit(0.05) * F.col("n") + F.lit(1e-6)
    return both.select(
        "operational_ha",
        "analytical_ha",
        (F.abs(F.col("operational_ha") - F.col("analytical_ha")) <= slack).alias("agree"),
    )
