"""Reconciliation of a full-set poll with the event table.

Each step returns only the rows it changes, as event rows with an ``action``; ``apply_changes``
folds them into the table. Steps run in order: upsert, superseded, vanished.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.functions import values
from emberlake.operators import grid
from emberlake.session import materialised

KEY = ["source", "external_id"]
CONTENT = ["hazard_type", "geom", "severity", "starts_at", "ends_at", "attrs", "content_hash"]
EVENT_COLUMNS = schemas.EVENTS.fieldNames()


def dedupe_last(rows: DataFrame, ordinal: str, by: list[str] | None = None) -> DataFrame:
    """Last occurrence per key by ``ordinal``: an aggregate, so repeats of a key combine before
    the shuffle."""
    by = by or KEY
    carried = [c for c in rows.columns if c not in by and c != ordinal]
    return (
        rows.groupBy(*by)
        .agg(F.max_by(F.struct(*carried), F.col(ordinal)).alias("last"))
        .select(*by, "last.*")
    )


def _touched(state: DataFrame, keys: DataFrame) -> DataFrame:
    """State rows of the given keys. A small key set is broadcast by the planner and the state
    is only streamed through, not shuffled."""
    return state.join(keys.select(*KEY).distinct(), KEY, "left_semi")


def reconcile(state: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """Idempotent upsert: new keys are inserted, known ones updated iff content or end differ.

    A known event served open again is thereby reopened. ``batch`` has one row per key.
    """
    known = _touched(state, batch).select(
        *KEY,
        F.col("content_hash").alias("_hash"),
        F.col("ends_at").alias("_end"),
        F.col("created_at").alias("_created"),
        F.lit(True).alias("_known"),
    )
    differs = ~F.col("content_hash").eqNullSafe(F.col("_hash")) | ~F.col("ends_at").eqNullSafe(
        F.col("_end")
    )
    action = F.when(F.col("_known").isNull(), "inserted").when(differs, "updated")
    judged = batch.join(known, KEY, "left").withColumn("action", action)
    return judged.where(F.col("action").isNotNull()).select(
        values.event_id(F.col("source"), F.col("external_id")).alias("id"),
        *KEY,
        *CONTENT,
        F.coalesce(F.col("_created"), at).alias("created_at"),
        at.alias("updated_at"),
        "action",
    )


def close_events(state: DataFrame, closings: DataFrame, at: Column) -> DataFrame:
    """Bound the window of the events named by closings(source, external_id, ended_at).

    Only events open at that time are touched: no end, or a later one.
    """
    return _closed(state, closings.groupBy(*KEY).agg(F.min("ended_at").alias("_to")), at)


def _closed(state: DataFrame, earliest: DataFrame, at: Column) -> DataFrame:
    """Events ended at ``_to`` of their key, with the other columns that ``earliest`` has of it."""
    extra = [c for c in earliest.columns if c not in (*KEY, "_to")]
    return (
        state.join(earliest, KEY)
        .where(F.col("ends_at").isNull() | (F.col("ends_at") > F.col("_to")))
        .withColumn("ends_at", F.col("_to"))
        .withColumn("updated_at", at)
        .withColumn("action", F.lit("closed"))
        .select(*EVENT_COLUMNS, "action", *extra)
    )


def vanished(previous: DataFrame, current: DataFrame, at: Column) -> DataFrame:
    """Closings for keys of the previous bulletin that the current one no longer carries."""
    gone = previous.select(*KEY).join(current.select(*KEY), KEY, "left_anti")
    return gone.select(*KEY, at.alias("ended_at"))


def close_vanished(
    state: DataFrame, previous: DataFrame, current: DataFrame, at: Column
) -> DataFrame:
    return close_events(state, vanished(previous, current, at), at)


def superseded(warnings: DataFrame) -> DataFrame:
    """Closings named by the references of updates and cancellations, once per (key, moment).

    ``turn`` is the first position of the moment in the bulletin: the order closings run in.
    """
    named = (
        warnings.where(F.col("msg_type").isin("Update", "Cancel") & (F.size("references") > 0))
        .select("ordinal", F.col("sent").alias("ended_at"), F.explode("references").alias("external_id"))
        .groupBy("external_id", "ended_at")
        .agg(F.min("ordinal").alias("_first"))
    )
    turns = (
        warnings.where(F.col("msg_type").isin("Update", "Cancel") & (F.size("references") > 0))
        .groupBy(F.col("sent").alias("ended_at"))
        .agg(F.min("ordinal").alias("turn"))
    )
    # All messages of a bulletin may carry one moment.
    return grid.spread_join(named, turns, ["ended_at"], F.col("external_id")).select(
        F.lit("aemet").alias("source"), "external_id", "ended_at", "turn"
    )


def close_superseded(state: DataFrame, warnings: DataFrame, at: Column) -> DataFrame:
    """Close referenced events at their superseder's moment.

    Several moments for one event end it at the earliest. ``closings`` counts how often it was
    closed on the way: each turn that lowers the end reached so far counts once.
    """
    # written, as the planner cannot know how many references there are
    steps = materialised(superseded(warnings), "closings")
    ends = state.select(*KEY, F.col("ends_at").alias("_end"))
    before = (
        Window.partitionBy(*KEY).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.least(F.min("ended_at").over(before), F.col("_end"))
    # one pass for the earliest moment and the count, so that the events meet them once
    counted = (
        steps.join(ends, KEY)
        .withColumn("_reached", reached)
        .groupBy(*KEY)
        .agg(
            F.min("ended_at").alias("_to"),
            F.count_if(F.col("_reached").isNull() | (F.col("_reached") > F.col("ended_at"))).alias("closings"),
        )
        .where(F.col("closings") > 0)
    )
    return _closed(state, counted, at)


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after a step: changed rows replace those of the same key."""
    return state.join(changes.select(*KEY), KEY, "left_anti").unionByName(
        changes.select(*state.columns)
    )


def change_counts(changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """inserted / updated / closed per source (or the given columns)."""
    weight = F.col("closings") if "closings" in changes.columns else F.lit(1)

    def total(name):
        hit = F.when(F.col("action") == name, weight).otherwise(F.lit(0))
        return F.sum(hit).cast("bigint").alias(name)

    return changes.groupBy(*(by or ["source"])).agg(*[total(a) for a in ("inserted", "updated", "closed")])


def last_bulletin(rows: DataFrame, poll: str = "poll_no") -> DataFrame:
    """Keys of the newest poll of each source: the table that stands in for an id cursor."""
    newest = rows.groupBy("source").agg(F.max(poll).alias(poll))
    # one row per source
    return rows.join(F.broadcast(newest), ["source", poll], "left_semi").select(*KEY).distinct()


def utc(moment: dt.datetime) -> Column:
    return F.lit(moment).cast("timestamp")
