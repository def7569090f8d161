"""Listing filters, keyset pages and lookups over the event table."""

from __future__ import annotations

import datetime as dt
from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.functions import geometry, values
from emberlake.operators import checks
from emberlake.session import materialised


def is_active(as_of: dt.datetime) -> Column:
    """Started and still open, or its window covers the moment."""
    t = F.lit(as_of)
    return (F.col("starts_at") <= t) & (F.col("ends_at").isNull() | (F.col("ends_at") >= t))


def apply_filters(
    events: DataFrame,
    *,
    bbox=None,
    hazard_types: Collection[str] | None = None,
    source: str | None = None,
    severity_min: int | None = None,
    starts_after: dt.datetime | None = None,
    starts_before: dt.datetime | None = None,
    active_at: dt.datetime | None = None,
) -> DataFrame:
    """The filters shared by the listing, radius and cluster operators.

    An unset argument and an empty type list filter nothing. Each condition is a plain comparison
    and reaches the Parquet scan.
    """
    if severity_min is not None:
        checks.severity(severity_min)
    if bbox is not None:
        events = filter_bbox(events, bbox)
    if hazard_types:
        events = events.where(F.col("hazard_type").isin(*hazard_types))
    if source is not None:
        events = events.where(F.col("source") == source)
    if severity_min is not None:
        events = events.where(F.col("severity") >= severity_min)
    if starts_after is not None:
        events = events.where(F.col("starts_at") >= F.lit(starts_after))
    if starts_before is not None:
        events = events.where(F.col("starts_at") <= F.lit(starts_before))
    if active_at is not None:
        events = events.where(is_active(active_at))
    return events


def filter_bbox(events: DataFrame, bbox) -> DataFrame:
    """Events whose geometry meets the envelope: box comparisons first, then the exact test."""
    return events.where(geometry.intersects_box(F.col("geom"), checks.bbox(bbox)))


def page_after(
    events: DataFrame,
    *,
    limit: int = 100,
    after: tuple[dt.datetime, str] | None = None,
) -> DataFrame:
    """One keyset page, newest first, of ``limit`` rows plus one.

    The extra row tells that more exist; ``next_key`` reads the following key off the page.
    """
    checks.limit(limit)
    if after is not None:
        moment, event_id = F.lit(after[0]), F.lit(after[1])
        # The first comparison is implied by the second and is the one the scan can use.
        events = events.where(
            (F.col("starts_at") <= moment)
            & (
                F.struct("starts_at", "id")
                < F.struct(moment.alias("starts_at"), event_id.alias("id"))
            )
        )
    return events.orderBy(F.col("starts_at").desc(), F.col("id").desc()).limit(limit + 1)


def next_key(page_rows: list, limit: int) -> tuple[dt.datetime, str] | None:
    """Key for the next page out of the at most ``limit + 1`` collected rows."""
    if len(page_rows) <= limit:
        return None
    last = page_rows[limit - 1]
    return last["starts_at"], last["id"]


def events_by_ids(events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events found, ids missing) for a frame of ids. One pass over the events; its result is written once and split."""
    wanted = ids.select("id").distinct()
    met = materialised(wanted.join(events.withColumn("_found", F.lit(True)), "id", "left"), "lookup")
    return met.where("_found").select(*events.columns), met.where(F.col("_found").isNull()).select("id")


def domain_problem() -> Column:
    """Name of the violated domain rule, NULL when the row is sound."""
    # A NULL is a violation of its own: each of these columns is mandatory.
    def member(name, allowed):
        return F.coalesce(F.col(name).isin(*allowed), F.lit(False))

    grade = F.coalesce(
        F.col("severity").between(schemas.SEVERITY_MIN, schemas.SEVERITY_MAX), F.lit(False)
    )
    return (
        F.when(~member("source", schemas.SOURCES), F.lit("source"))
        .when(~member("hazard_type", schemas.HAZARD_TYPES), F.lit("hazard_type"))
        .when(~grade, F.lit("severity"))
        .when(F.col("external_id").isNull(), F.lit("external_id"))
        .when(F.col("starts_at").isNull(), F.lit("starts_at"))
        .when(F.col("geom").isNull(), F.lit("geom"))
    )


def check_domain(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sound rows, quarantined rows with the violated rule in ``problem``)."""
    judged = events.withColumn("problem", domain_problem())
    return (
        judged.where(F.col("problem").isNull()).drop("problem"),
        judged.where(F.col("problem").isNotNull()),
    )


def backfill_instants(events: DataFrame) -> DataFrame:
    """Close point events that still lack an end: quakes and hotspots end as they start."""
    instant = (F.col("source") == "ign") | (
        (F.col("source") == "effis") & (values.attr(F.col("attrs"), "kind") == "hotspot")
    )
    return events.withColumn(
        "ends_at",
        F.when(F.col("ends_at").isNull() & instant, F.col("starts_at")).otherwise(F.col("ends_at")),
    )


def ingestible_warnings(warnings: DataFrame) -> DataFrame:
    """Alerts and updates above the no-risk level that carry an area and a window."""
    level = F.lower(F.trim(F.col("level")))
    return warnings.where(
        F.col("msg_type").isin("Alert", "Update")
        & F.col("level").isNotNull()
        & (level != "verde")
        & (F.length("polygon") > 0)
        & F.col("onset").isNotNull()
        & F.col("expires").isNotNull()
    )
