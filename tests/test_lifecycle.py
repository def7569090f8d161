"""Reconciliation, history and freshness on the golden cases."""

import datetime as dt
import random

import pytest
from helpers import BASE, event, events_frame, point
from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.operators import lifecycle, replay, status
from emberlake.session import materialised

UTC = dt.timezone.utc


def empty(spark):
    return spark.createDataFrame([], schemas.EVENTS)


def batch(spark, rows):
    return events_frame(spark, rows).drop("id")


def counts(changes):
    row = lifecycle.change_counts(changes).first()
    return (row["inserted"], row["updated"], row["closed"]) if row else (0, 0, 0)


def at(hours=0):
    return F.lit(BASE + dt.timedelta(hours=hours)).cast("timestamp")


def test_large_batch_identical_batch_and_three_changes(spark):
    rows = spark.range(4001).select(
        F.lit("effis").alias("source"), F.concat(F.lit("hs-"), F.col("id")).alias("external_id"),
        F.lit("wildfire").alias("hazard_type"), F.lit(None).cast(schemas.GEOMETRY).alias("geom"),
        F.lit(2).cast("smallint").alias("severity"), at().alias("starts_at"), at().alias("ends_at"),
        F.lit("{}").alias("attrs"), F.lit("h").alias("content_hash"),
    )
    first = lifecycle.reconcile(empty(spark), rows, at())
    assert counts(first) == (4001, 0, 0)
    state = first.drop("action").cache()
    assert counts(lifecycle.reconcile(state, rows, at(1))) == (0, 0, 0)
    changed = rows.withColumn(
        "content_hash", F.when(F.col("external_id").isin("hs-1", "hs-2", "hs-4000"), "new").otherwise("h")
    )
    assert counts(lifecycle.reconcile(state, changed, at(1))) == (0, 3, 0)


def test_severity_alone_is_no_change(spark):
    a = batch(spark, [event("a", point(0, 0), severity=2)])
    state = lifecycle.reconcile(empty(spark), a, at()).drop("action")
    b = a.withColumn("severity", F.lit(4).cast("smallint"))
    assert counts(lifecycle.reconcile(state, b, at(1))) == (0, 0, 0)


def test_last_duplicate_wins(spark):
    rows = batch(spark, [event("a", point(0, 0), severity=1), event("a", point(0, 0), severity=3)])
    numbered = rows.withColumn("ordinal", F.col("severity"))
    got = lifecycle.dedupe_last(numbered, "ordinal").collect()
    assert [r["severity"] for r in got] == [3]


def test_closing_touches_only_open_windows_and_reopens(spark):
    rows = batch(
        spark,
        [
            event("open", point(0, 0)),
            event("later", point(0, 0), ends_at=BASE + dt.timedelta(hours=6)),
            event("expired", point(0, 0), ends_at=BASE - dt.timedelta(hours=1)),
        ],
    )
    state = lifecycle.reconcile(empty(spark), rows, at(-3)).drop("action")
    ids = rows.select(*lifecycle.KEY, at().alias("ended_at"))
    closed = lifecycle.close_events(state, ids, at())
    assert {r["external_id"] for r in closed.collect()} == {"open", "later"}
    after = lifecycle.apply_changes(state, closed)
    again = lifecycle.close_events(after, ids, at(1))
    assert again.count() == 0
    assert counts(lifecycle.reconcile(after, rows, at(1))) == (0, 2, 0)


def message(spark, rows):
    return spark.createDataFrame(
        rows, "ordinal int, external_id string, msg_type string, sent timestamp, references array<string>"
    )


def test_superseding_takes_the_earliest_moment_and_counts_steps(spark):
    rows = batch(spark, [event("x", point(0, 0), source="aemet", ends_at=BASE + dt.timedelta(hours=9))])
    state = lifecycle.reconcile(empty(spark), rows, at(-3)).drop("action")
    h = lambda n: BASE + dt.timedelta(hours=n)
    falling = message(spark, [(1, "u", "Update", h(3), ["x"]), (2, "c", "Cancel", h(1), ["x"]),
                              (3, "v", "Update", h(2), ["x"]), (4, "a", "Alert", h(0), ["x"])])
    got = lifecycle.close_superseded(state, falling, at())
    assert counts(got) == (0, 0, 2)
    assert got.select(F.col("ends_at") == at(1)).first()[0]
    rising = message(spark, [(1, "c", "Cancel", h(1), ["x"]), (2, "u", "Update", h(3), ["x", "unknown"])])
    assert counts(lifecycle.close_superseded(state, rising, at())) == (0, 0, 1)


def test_superseded_events_meet_the_moments_twice(spark):
    """Once for the ends reached on the way and once for the closing: every further join sorts the events in the same task."""
    h = lambda n: BASE + dt.timedelta(hours=n)
    rows = batch(spark, [event(n, point(0, 0), source="aemet", ends_at=h(e)) for n, e in (("x", 9), ("y", 1), ("z", 9))])
    state = materialised(lifecycle.reconcile(empty(spark), rows, at(-3)).drop("action"))
    sent = message(spark, [(1, "u", "Update", h(3), ["x", "y"]), (2, "c", "Cancel", h(2), ["x", "gone"])])
    got = lifecycle.close_superseded(state, sent, at(5))
    assert got._jdf.queryExecution().analyzed().toString().count("Join ") == 2
    found = got.select("external_id", (F.col("ends_at") == at(2)).alias("first"), "closings", "action").collect()
    assert [tuple(r) for r in found] == [("x", True, 2, "closed")]


@pytest.mark.parametrize("block", [1024, 4])
def test_replay_equals_the_poll_by_poll_fold(spark, monkeypatch, block):
    monkeypatch.setattr(replay, "BLOCK", block)
    rnd = random.Random(8)
    polls = 23
    rows, hot = [], []
    for p in range(polls):
        if p in (9, 10):
            continue  # empty polls
        hot.append(("effis", p, "hot", "same", 0))
        for k in range(12):
            if rnd.random() < 0.6:
                rows.append(("effis", p, f"k{k}", str(rnd.randint(0, 1)), 0))
                if rnd.random() < 0.2:
                    rows.append(("effis", p, f"k{k}", str(rnd.randint(0, 1)), 1))
    schema = "source string, poll_no long, external_id string, content_hash string, ordinal int"
    df = spark.createDataFrame(rows + hot, schema)
    cal = spark.createDataFrame(
        [("effis", p, BASE + dt.timedelta(days=p)) for p in range(polls)],
        "source string, poll_no long, poll_ts timestamp",
    )
    open_, last, seen_ever, want, intervals = {}, {}, set(), {}, []
    for p in range(polls):
        now = {}
        for s, n, k, h, o in sorted(rows + hot, key=lambda r: r[4]):
            if n == p:
                now[k] = h
        ins = upd = clo = 0
        for k, h in now.items():
            if k not in seen_ever:
                ins += 1
            elif k not in open_ or last[k] != h:
                upd += 1
            if k not in open_:
                open_[k] = [p, 0, 0]
            elif last[k] != h:
                open_[k][2] += 1
            open_[k][1] += 1
            seen_ever.add(k)
            last[k] = h
        for k in [k for k in open_ if k not in now]:
            a, n, c = open_.pop(k)
            intervals.append((k, a, p, n, c))
            clo += 1
        want[p] = (ins, upd, clo)
    intervals += [(k, a, None, n, c) for k, (a, n, c) in open_.items()]
    got = {r["poll_no"]: (r["inserted"], r["updated"], r["closed"]) for r in replay.replay_counts(df, cal).collect()}
    assert got == want
    lines = [
        (r["external_id"], r["opened_no"], r["closed_no"], r["polls"], r["changes"])
        for r in replay.replay_polls(df, cal).collect()
    ]
    assert sorted(lines, key=str) == sorted(intervals, key=str)


def log(spark, rows):
    return spark.createDataFrame(
        [(f"{i:03d}", s, BASE + dt.timedelta(seconds=t), ok, err, cur) for i, (s, t, ok, err, cur) in enumerate(rows)],
        schemas.POLL_LOG,
    )


def test_sync_state_and_freshness(spark):
    df = log(
        spark,
        [
            ("effis", 0, True, None, "c1"),
            ("effis", 100, False, "x" * 900, None),
            ("effis", 200, False, "y" * 900, None),
            ("ign", 0, False, "down", None),
            ("ign", 50, True, None, "c2"),
            ("ign", 90, True, None, None),
            ("aemet", 5, False, "never", None),
            ("spare", 0, True, None, None),
        ],
    )
    state = {r["source"]: r for r in status.sync_state(df).collect()}
    assert state["effis"]["consecutive_failures"] == 2 and state["effis"]["last_error"] == "y" * 900
    cut = status.sync_state(df, error_chars=500).where("source = 'effis'").first()
    assert cut["last_error"] == "y" * 500
    assert state["effis"]["cursor"] == "c1"
    assert state["ign"]["consecutive_failures"] == 0 and state["ign"]["last_error"] is None
    assert state["ign"]["cursor"] == "c2"
    assert state["aemet"]["last_success_at"] is None and state["aemet"]["consecutive_failures"] == 1

    now = BASE + dt.timedelta(seconds=90 + 3 * 900)
    jobs = status.cadence(spark, (*status.CADENCE, ("fresh_sync", 60)))
    rows = {r["source"]: r for r in status.source_status(status.sync_state(df), jobs, now).collect()}
    assert rows["ign"]["stale"] is False and rows["ign"]["healthy"]  # exactly three intervals
    assert rows["effis"]["healthy"] and rows["effis"]["has_error"]
    assert rows["aemet"]["stale"] and rows["fresh"]["stale"] and not rows["fresh"]["healthy"]
    assert rows["spare"]["interval_seconds"] is None and rows["spare"]["healthy"]
    late = status.source_status(status.sync_state(df), jobs, now + dt.timedelta(seconds=1))
    assert {r["source"] for r in late.where("stale").collect()} == {"ign", "aemet", "fresh"}
    assert status.overall_status(late).first()["status"] == "degraded"
    assert status.overall_status(late.where("healthy")).first()["status"] == "ok"


def test_three_failures_are_unhealthy(spark):
    df = log(spark, [("ign", 0, True, None, None), *[("ign", i, False, "e", None) for i in (1, 2, 3)]])
    row = status.source_status(status.sync_state(df), status.cadence(spark), BASE).where("source = 'ign'").first()
    assert not row["stale"] and not row["healthy"]
