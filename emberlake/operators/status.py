"""Source freshness: the fold of an append-only poll log, judged against each source's cadence."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Cadence per job, staleness factor, failures tolerated.
CADENCE = (("effis_sync", 14_400), ("ign_sync", 900), ("aemet_sync", 1_800))
STALENESS_FACTOR = 3
MAX_FAILURES = 3


def cadence(spark: SparkSession, rows=CADENCE) -> DataFrame:
    return spark.createDataFrame(list(rows), "job_name string, interval_seconds int")


def sync_state(poll_log: DataFrame, error_chars: int | None = None) -> DataFrame:
    """Per source: last run, last success, cursor, error and failures since the last success.

    ``error_chars`` cuts the error text; it is whole by default.

    A success clears the error and the count, and replaces the cursor only when it brings one.
    Two partial aggregations; the few sources never gather their log in one task.
    """
    log = poll_log.withColumn("_at", F.struct("ts", "poll_id"))
    good = F.when(F.col("ok"), F.col("_at"))
    head = log.groupBy("source").agg(
        F.max("ts").alias("last_run_at"),
        F.max(good).alias("_success"),
        F.max_by("cursor", F.when(F.col("cursor").isNotNull(), good)).alias("cursor"),
    )
    error = F.col("err") if error_chars is None else F.substring("err", 1, error_chars)
    since = (
        log.where(~F.col("ok"))
        .join(F.broadcast(head.select("source", "_success")), "source")  # one row per source
        .where(F.col("_success").isNull() | (F.col("_at") > F.col("_success")))
        .groupBy("source")
        .agg(
            F.count("*").alias("_failures"),
            F.max_by(error, "_at").alias("last_error"),
        )
    )
    return head.join(since, "source", "left").select(
        "source",
        "last_run_at",
        F.col("_success.ts").alias("last_success_at"),
        "cursor",
        "last_error",
        F.coalesce(F.col("_failures"), F.lit(0)).cast("int").alias("consecutive_failures"),
    )


def source_status(state: DataFrame, jobs: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Freshness of every scheduled or observed source at a moment.

    A scheduled source without a state is stale; an unscheduled one never is.
    """
    planned = jobs.where(F.col("job_name").endswith("_sync")).select(
        F.regexp_replace("job_name", "_sync$", "").alias("source"), "interval_seconds"
    )
    now = F.lit(as_of).cast("timestamp")
    # Fractions of a second count: staleness is a strict comparison.
    elapsed = (F.unix_micros(now) - F.unix_micros("last_success_at")) / F.lit(1e6)
    limit = F.lit(STALENESS_FACTOR) * F.col("interval_seconds")
    stale = F.col("interval_seconds").isNotNull() & (
        F.col("seconds_since_success").isNull() | (F.col("seconds_since_success") > limit)
    )
    return (
        state.join(planned, "source", "full_outer")
        .withColumn("seconds_since_success", elapsed)
        .withColumn(
            "consecutive_failures", F.coalesce(F.col("consecutive_failures"), F.lit(0))
        )
        .withColumn("stale", stale)
        .select(
            "source",
            "last_run_at",
            "last_success_at",
            "seconds_since_success",
            "consecutive_failures",
            (F.coalesce(F.length("last_error"), F.lit(0)) > 0).alias("has_error"),
            "interval_seconds",
            "stale",
            (~F.col("stale") & (F.col("consecutive_failures") < MAX_FAILURES)).alias("healthy"),
        )
    )


def overall_status(status: DataFrame) -> DataFrame:
    """One row: ok when every source is healthy."""
    return status.agg(
        F.when(F.coalesce(F.bool_and("healthy"), F.lit(True)), "ok").otherwise("degraded").alias("status"),
        F.count("*").alias("sources"),
    )
