"""Lifecycle history of many full-set polls at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.operators.lifecycle import KEY, dedupe_last

# Polls per block. A key is worked on block by block, so even one that is served in every poll of
# a long history never gathers in a single window.
BLOCK = 1024


def _runs(df: DataFrame, window, keys: list[str]) -> DataFrame:
    """Join consecutive pieces (first_no, last_no, ...) into runs within ``window``."""
    follows = F.lag("last_no").over(window) == F.col("first_no") - 1
    turned = F.lag("last_hash").over(window) != F.col("first_hash")
    marked = df.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn(
        "_turn", F.when(follows & turned, 1).otherwise(0)
    )
    numbered = marked.withColumn("_run", F.sum("_new").over(window))
    return numbered.groupBy(*keys, "_run").agg(
        F.min("first_no").alias("first_no"),
        F.max("last_no").alias("last_no"),
        F.min_by("first_hash", "first_no").alias("first_hash"),
        F.max_by("last_hash", "last_no").alias("last_hash"),
        F.sum("polls").alias("polls"),
        (F.sum("changes") + F.sum("_turn")).alias("changes"),
    )


def presence_runs(rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Maximal runs of consecutive polls that serve a key, with its content changes inside.

    rows(source, poll_no, external_id, content_hash, ordinal); ``poll_no`` counts the polls of a
    source without gaps.
    """
    seen = dedupe_last(
        rows.select(*KEY, "poll_no", "content_hash", ordinal), ordinal, [*KEY, "poll_no"]
    )
    single = seen.select(
        *KEY,
        F.floor(F.col("poll_no") / BLOCK).alias("_block"),
        F.col("poll_no").alias("first_no"),
        F.col("poll_no").alias("last_no"),
        F.col("content_hash").alias("first_hash"),
        F.col("content_hash").alias("last_hash"),
        F.lit(1).cast("bigint").alias("polls"),
        F.lit(0).cast("bigint").alias("changes"),
    )
    in_block = [*KEY, "_block"]
    pieces = _runs(single, Window.partitionBy(*in_block).orderBy("first_no"), in_block)
    out = [*KEY, "first_no", "last_no", "polls", "changes"]
    at_edge = (F.col("first_no") % BLOCK == 0) | (F.col("last_no") % BLOCK == BLOCK - 1)
    stitched = _runs(
        pieces.where(at_edge).drop("_run", "_block"),
        Window.partitionBy(*KEY).orderBy("first_no"),
        KEY,
    )
    return pieces.where(~at_edge).select(*out).unionByName(stitched.select(*out))


def replay_polls(rows: DataFrame, calendar: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Open/close intervals of every key over the whole poll history.

    calendar(source, poll_no, poll_ts) lists all successful polls, empty ones included. A key
    opens with the first poll of a run and closes with the first poll that lacks it; the last run
    stays open when it reaches the end of the history.
    """
    runs = presence_runs(rows, ordinal)
    first = runs.groupBy(*KEY).agg(F.min("first_no").alias("_born"))
    opened = calendar.select("source", F.col("poll_no").alias("first_no"), F.col("poll_ts").alias("opened_at"))
    closed = calendar.select(
        "source", (F.col("poll_no") - 1).alias("last_no"), F.col("poll_ts").alias("closed_at")
    )
    return (
        runs.join(first, KEY)
        .join(opened, ["source", "first_no"])
        .join(closed, ["source", "last_no"], "left")
        .select(
            *KEY,
            F.col("first_no").alias("opened_no"),
            F.when(F.col("closed_at").isNotNull(), F.col("last_no") + 1).alias("closed_no"),
            "opened_at",
            "closed_at",
            "polls",
            "changes",
            (F.col("first_no") > F.col("_born")).alias("reopened"),
        )
    )


def replay_counts(rows: DataFrame, calendar: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """inserted / updated / closed per poll, as the poll-by-poll reconciliation would count them."""
    seen = dedupe_last(
        rows.select(*KEY, "poll_no", "content_hash", ordinal), ordinal, [*KEY, "poll_no"]
    )
    # Neighbouring polls meet by an equi-join on (key, poll), which spreads a key over all tasks.
    before = seen.select(
        *KEY, (F.col("poll_no") + 1).alias("poll_no"), F.col("content_hash").alias("_was")
    )
    both = seen.join(before, [*KEY, "poll_no"], "full_outer")
    born = seen.groupBy(*KEY).agg(F.min("poll_no").alias("_born"))
    acts = (
        both.join(born, KEY)
        .select(
            "source",
            "poll_no",
            F.when(F.col("content_hash").isNull(), "closed")
            .when(F.col("poll_no") == F.col("_born"), "inserted")
            .when(~F.col("content_hash").eqNullSafe(F.col("_was")), "updated")
            .alias("action"),
        )
        .where(F.col("action").isNotNull())
    )

    def total(name):
        return F.coalesce(F.sum((F.col("action") == name).cast("bigint")), F.lit(0)).alias(name)

    names = ("inserted", "updated", "closed")
    per_poll = acts.groupBy("source", "poll_no").agg(*[total(a) for a in names])
    return calendar.join(per_poll, ["source", "poll_no"], "left").select(
        "source", "poll_no", "poll_ts",
        *[F.coalesce(F.col(a), F.lit(0)).cast("bigint").alias(a) for a in names],
    )
