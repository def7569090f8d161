"""Sync jobs: one micro-batch is one landed poll, reconciled with the event store.

Landing a poll writes its documents (poll_id, doc_id, layer, payload) as a table of their own and
then a one-row marker (poll_id, poll_ts, documents, err). The stream follows the markers, one per
batch and in order; the documents of a poll are read by all tasks. A marker with ``err`` stands
for a poll whose fetch failed.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from emberlake import schemas, session
from emberlake.operators import lifecycle
from emberlake.operators.lifecycle import KEY
from emberlake.sources import feeds, snapshot
from emberlake.streaming import store

logger = logging.getLogger(__name__)

DOCUMENTS = "poll_id string, doc_id string, layer string, payload string"
# Longest error text kept in the sync state.
MAX_ERROR = 500
# What a poll that closes nothing compares its rows with, and where they were.
JUDGED = ["content_hash", "starts_at", "ends_at", "created_at"]
MARKER = "poll_id string, poll_ts timestamp, documents string, err string"


def materialised(df: DataFrame, label: str = "step") -> DataFrame:
    return session.materialised(df, label, codec="zstd")


@dataclass(frozen=True)
class Bulletin:
    """One poll, read: event rows, keys whose absence closes, and closing messages."""

    rows: DataFrame
    watched: DataFrame | None
    messages: DataFrame | None
    cursor: str | None


def _layer(documents: DataFrame, name: str) -> DataFrame:
    return documents.where(F.col("layer") == name)


class RefusedPoll(Exception):
    """A poll that must not be applied: taking what is left of it would close live events."""


def _accepted(records: DataFrame, whole: bool = False) -> DataFrame:
    """Good records of a poll; refuses a poll that holds units but no good one.

    With ``whole``, every document must be readable and there must be one: records that a document
    does not show would else count as gone.
    """
    records = materialised(records, "records")
    if whole:
        readable = records.agg(F.bool_and("readable")).first()[0]
        if readable is None:
            raise RefusedPoll("a layer has no document")
        if not readable:
            raise RefusedPoll("a document cannot be read")
    good, _, gate = feeds.split_malformed(records)
    if not gate.where(F.col("verdict") == "failed").isEmpty():
        raise RefusedPoll("no unit of the poll could be parsed")
    return good


def _last_records(records: DataFrame) -> DataFrame:
    """The last record of each id, by its place in the poll: a record is narrower than the event row made of it."""
    placed = records.drop("readable", "unit", "parse_ok").withColumn("ordinal", F.struct("doc_id", "position"))
    return lifecycle.dedupe_last(placed, "ordinal", ["external_id"])


def read_fires(documents: DataFrame) -> Bulletin:
    """Both fire layers, whose ids differ by their prefix. Burnt areas missing from the next poll will be closed."""
    hotspots = _accepted(feeds.ingest_hotspots(_layer(documents, "hotspots")), whole=True)
    areas = _accepted(feeds.ingest_burnt_areas(_layer(documents, "burnt_areas")), whole=True)
    rows = feeds.fire_events(_last_records(hotspots), _last_records(areas)).drop("poll_id", "ordinal")
    watched = areas.select(F.lit("effis").alias("source"), "external_id").distinct()
    return Bulletin(rows, watched, None, None)


def read_quakes(documents: DataFrame) -> Bulletin:
    """The quake window. Nothing closes; the cursor is the latest event of a non-empty poll."""
    good = _accepted(feeds.ingest_quakes(_layer(documents, "quakes")), whole=True)
    latest = good.agg(F.max("occurred_at").cast("string").alias("t")).first()["t"]
    rows = feeds.quake_events(_last_records(good)).drop("poll_id", "ordinal")
    return Bulletin(rows, None, None, latest)


def read_warnings(documents: DataFrame, **limits: int) -> Bulletin:
    """A warning bulletin: references close first, then what the bulletin no longer carries."""
    kept, refused = feeds.bulletin_guard(_layer(documents, "warnings"), **limits)
    if not refused.isEmpty():
        raise RefusedPoll("the bulletin exceeds its limits")
    good = _accepted(feeds.ingest_warnings(kept))
    rows, _ = feeds.warning_events(good)
    # written, as an event costs far more to make of its message than to read
    rows = materialised(lifecycle.dedupe_last(rows.drop("poll_id"), "ordinal"), "poll")
    watched = rows.select(*KEY)
    messages = good.select("msg_type", "sent", "references", F.col("doc_id").alias("ordinal"))
    return Bulletin(rows, watched, messages, None)


READERS: dict[str, Callable[..., Bulletin]] = {
    "effis": read_fires,
    "ign": read_quakes,
    "aemet": read_warnings,
}


def reconcile_poll(
    spark: SparkSession,
    marker: Row,
    batch_id: int,
    root: str,
    source: str,
    most_runs: int = store.MOST_RUNS,
    snapshot_every: int = 1,
    skip_refused: bool = False,
    buckets: int = store.BUCKETS,
    **limits: int,
) -> tuple[int, int, int] | None:
    """Apply one poll to the store and return (inserted, updated, closed).

    A failed fetch is logged and changes nothing. A refused poll is set aside in ``refused`` with its
    reason, changes nothing and leaves no log row. It stops the stream, unless ``skip_refused`` says to go on
    with the next poll. ``buckets`` counts when the store is begun and holds for its life.
    """
    try:
        manifest = store.begin(spark, root, batch_id, buckets)
        _in_order(manifest, marker, source)
        counts = _apply_poll(spark, marker, manifest, root, source, **limits)
    except RefusedPoll as problem:
        logger.warning("%s poll %s not applied: %s", source, marker["poll_id"], problem)
        row = spark.createDataFrame([(marker["poll_id"], source, str(problem))], store.SCHEMAS["refused"])
        store.write_folder(row, root, "refused", f"batch={batch_id}")
        if not skip_refused:
            raise
        return None
    store.commit(spark, root, manifest)
    # what follows is upkeep of a committed state; a batch that is lost here is caught up by the next
    kept = bool(snapshot_every) and _refresh_snapshot(spark, root, manifest, snapshot_every)
    if store.merge_runs(spark, root, manifest, most_runs) or kept:
        store.commit(spark, root, manifest)
    return counts


def _in_order(manifest: store.Manifest, marker: Row, source: str) -> None:
    """Polls are full sets: one from before the last applied poll would undo it."""
    last = manifest.polls.get(source)
    if last is not None and _instant(marker["poll_ts"]) < last["last_run_at"]:
        raise RefusedPoll("the poll is older than the last one")


def _instant(moment: dt.datetime) -> str:
    """UTC text of a moment that sorts like it. A row's moment without zone is one of the driver's zone."""
    return moment.astimezone(dt.timezone.utc).isoformat(timespec="microseconds")


def _log_poll(spark, root, manifest, source, marker, ok, err=None, cursor=None) -> None:
    """Add the poll to the log, and to the fold of the log that the manifest carries."""
    row = spark.createDataFrame(
        [(marker["poll_id"], source, marker["poll_ts"], ok, err, cursor)], store.SCHEMAS["poll_log"]
    )
    manifest.add("poll_log", store.write_folder(row.coalesce(1), root, "poll_log", f"batch={manifest.batch}"), {"0": 1})
    state = manifest.polls.setdefault(
        source, {"last_success_at": None, "cursor": None, "last_error": None, "consecutive_failures": 0}
    )
    state["last_run_at"] = _instant(marker["poll_ts"])
    if ok:
        state |= {"last_success_at": state["last_run_at"], "last_error": None, "consecutive_failures": 0}
        state["cursor"] = state["cursor"] if cursor is None else cursor
    else:
        state["consecutive_failures"] += 1
        state["last_error"] = (err or "")[:MAX_ERROR]


def _apply_poll(
    spark: SparkSession, marker: Row, manifest: store.Manifest, root: str, source: str, **limits: int
) -> tuple[int, int, int] | None:
    batch_id = manifest.batch
    if marker["err"] is not None:
        _log_poll(spark, root, manifest, source, marker, False, marker["err"])
        return None
    documents = spark.read.schema(DOCUMENTS).parquet(marker["documents"])
    bulletin = READERS[source](documents, **limits)
    at = F.lit(marker["poll_ts"]).cast("timestamp")
    rows = bulletin.rows
    previous = None
    wanted = rows.select(*KEY)
    if bulletin.watched is not None:
        watched = materialised(bulletin.watched, "watched")
        previous = store.read_table(spark, root, "bulletin", before=batch_id)
        wanted = wanted.unionByName(previous)
    messages = None
    if bulletin.messages is not None:
        messages = materialised(bulletin.messages, "messages")
        wanted = wanted.unionByName(lifecycle.superseded(messages).select(*KEY))
    # The events this poll can touch at all; the steps below run on them alone. Only what closes events needs them whole.
    closes = previous is not None or messages is not None
    columns = None if closes else JUDGED
    known = materialised(store.read_state(spark, root, before=batch_id, keys=wanted, columns=columns), "state")

    steps = [lifecycle.reconcile(known, rows, at).withColumn("closings", F.lit(1))]
    if closes:
        # a step is written once: the run, and the state of the next step, hold its rows
        steps[0] = materialised(steps[0], "upsert")
        state = lifecycle.apply_changes(known, steps[0])
    if messages is not None:
        state = materialised(state, "state")
        steps.append(materialised(lifecycle.close_superseded(state, messages, at), "superseded"))
        state = lifecycle.apply_changes(state, steps[-1])
    if previous is not None:
        gone = lifecycle.close_vanished(state, previous, watched, at)
        steps.append(gone.withColumn("closings", F.lit(1)))
    changes = None
    for number, step in enumerate(steps):
        step = step.withColumn("step", F.lit(number)).withColumn("batch", F.lit(batch_id).cast("bigint"))
        changes = step if changes is None else changes.unionByName(step)
    # written as the run they become; a run that turns out empty is named by no manifest
    changes = changes.withColumn("closings", F.col("closings").cast("bigint"))
    folder, sizes = store.write_events(changes, root, f"batch={batch_id}", manifest.buckets)
    changes = store.written_changes(spark, root, folder)
    counted = lifecycle.change_counts(changes).first()
    counts = (counted["inserted"], counted["updated"], counted["closed"]) if counted else (0, 0, 0)

    if bulletin.watched is not None:
        manifest.bulletin = store.write_folder(watched, root, "bulletin", f"batch={batch_id}")
    if any(counts):
        manifest.add("events", folder, sizes)
        manifest.unsaved.append(folder)
        manifest.touched = sorted({*map(tuple, manifest.touched), *_places(known, changes)})
        entry = spark.createDataFrame([(batch_id, source, *counts)], store.SCHEMAS["change_log"])
        manifest.add("change_log", store.write_folder(entry, root, "change_log", f"batch={batch_id}"), {"0": 1})
    _log_poll(spark, root, manifest, source, marker, True, cursor=bulletin.cursor)
    return counts


def _places(known: DataFrame, changes: DataFrame) -> list[tuple[str, int]]:
    """Sources and years the changed events were in before; at most one row per source and year."""
    were = known.join(changes.select(*KEY), KEY, "left_semi").select("source", F.year("starts_at").alias("year"))
    return [(r["source"], r["year"]) for r in were.distinct().collect()]


def _refresh_snapshot(spark: SparkSession, root: str, manifest: store.Manifest, every: int) -> bool:
    """Write what changed since the last snapshot as a new version, if that is old enough; tell whether one was written.

    Only the sources and years of changed events are rewritten.
    """
    if not manifest.unsaved or (manifest.snapshot is not None and manifest.batch - manifest.snapshot < every):
        return False
    rows = spark.read.schema(store.EVENTS).parquet(*[f"{root}/{folder}" for folder in manifest.unsaved])
    names = schemas.SNAPSHOT.fieldNames()
    changed = rows.select(*names)
    # a step has one row per key, so only runs of several steps hold a key twice
    if len(rows.select(*store.ORDER).distinct().take(2)) > 1:
        changed = materialised(store.newest(rows.select(*names, *store.ORDER)).select(*names), "changed")
    touched = [tuple(t) for t in manifest.touched]
    snapshot.update_snapshot(changed, touched, f"{root}/snapshot", version=manifest.batch)
    manifest.snapshot, manifest.unsaved, manifest.touched = manifest.batch, [], []
    return True


def start_sync(
    spark: SparkSession, landed: str, root: str, source: str, **options
):
    """Start the sync stream of one source over a folder of landed polls; it ends when all
    available polls are applied."""
    polls = (
        spark.readStream.schema(MARKER)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{landed}/markers")
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        marker = batch.first()
        if marker is not None:
            reconcile_poll(batch.sparkSession, marker, batch_id, root, source, **options)

    return (
        polls.writeStream.foreachBatch(apply)
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def sync_wildfires(spark: SparkSession, landed: str, root: str, **options) -> None:
    start_sync(spark, landed, root, "effis", **options).awaitTermination()


def sync_quakes(spark: SparkSession, landed: str, root: str, **options) -> None:
    start_sync(spark, landed, root, "ign", **options).awaitTermination()


def sync_warnings(spark: SparkSession, landed: str, root: str, **options) -> None:
    start_sync(spark, landed, root, "aemet", **options).awaitTermination()


def land_poll(
    documents: DataFrame | None,
    landed: str,
    poll_id: str,
    poll_ts: dt.datetime,
    spark: SparkSession,
    err: str | None = None,
) -> None:
    """Land one poll: its documents, then the marker the stream follows."""
    path = None
    if documents is not None:
        path = f"{landed}/documents/poll={poll_id}"
        documents.select(
            F.lit(poll_id).alias("poll_id"), "doc_id", "layer", "payload"
        ).write.mode("overwrite").option("compression", "zstd").parquet(path)
    marker = spark.createDataFrame([(poll_id, poll_ts, path, err)], MARKER)
    marker.coalesce(1).write.mode("append").parquet(f"{landed}/markers")


def change_log(spark: SparkSession, root: str) -> DataFrame:
    return store.read_table(spark, root, "change_log")


def poll_log(spark: SparkSession, root: str) -> DataFrame:
    return store.read_table(spark, root, "poll_log")


def sync_state(spark: SparkSession, root: str) -> DataFrame:
    """Last run, last success, cursor, error and failures per source, from the fold in the manifest: no log is read."""
    manifest = store.load(spark, root)
    fields = schemas.SYNC_STATE.fieldNames()
    moments = ("last_run_at", "last_success_at")
    rows = []
    for source, state in (manifest.polls if manifest else {}).items():
        given = {k: dt.datetime.fromisoformat(v) if k in moments and v else v for k, v in state.items()}
        rows.append(tuple((given | {"source": source})[f] for f in fields))
    return spark.createDataFrame(rows, schemas.SYNC_STATE)


def refused_polls(spark: SparkSession, root: str) -> DataFrame:
    return store.read_table(spark, root, "refused")


def events(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """The event table, or its key and some columns."""
    return store.read_state(spark, root, columns=columns)
