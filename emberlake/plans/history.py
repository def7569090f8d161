"""Poll reconciliation, history and source freshness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from emberlake.operators import lifecycle, replay, status
from emberlake.plans.carriers import POLLS_SQL, polls, table

UTC = dt.timezone.utc
AS_OF = dt.datetime(2024, 1, 31, 2, 0, tzinfo=UTC)
# The reconciliation step queries fold the polls before this one into the event table and take
# those from it on as one bulletin.
SPLIT = 15
BORN, AT = dt.datetime(2024, 1, 1, tzinfo=UTC), dt.datetime(2024, 1, 16, tzinfo=UTC)


def poll_rows(spark, d):
    return polls(spark, d).withColumn("content_hash", F.sha2(F.col("k").cast("string"), 256))


def calendar(spark, d):
    return polls(spark, d).select("source", "poll_no", "poll_ts").distinct()


def bulletin(spark, d, late: bool):
    """Last occurrence per (user, k % 20) of one part of the history, as event rows.

    Content follows from ``k``; where it is a multiple of four the event ends on its own.
    """
    part = F.col("poll_no") >= SPLIT if late else F.col("poll_no") < SPLIT
    rows = poll_rows(spark, d).where(part).select(
        "source",
        F.concat_ws("-", "external_id", (F.col("k") % 20).cast("string")).alias("external_id"),
        "ordinal",
        F.lit("wildfire").alias("hazard_type"),
        F.lit(None).cast(lifecycle.schemas.GEOMETRY).alias("geom"),
        (1 + F.col("k") % 4).cast("smallint").alias("severity"),
        F.col("poll_ts").alias("starts_at"),
        F.when(
            F.col("k") % 4 == 0, F.col("poll_ts") + F.make_dt_interval(days=F.col("k") % 25)
        ).alias("ends_at"),
        F.to_json(F.struct("k")).alias("attrs"),
        "content_hash",
    )
    return lifecycle.dedupe_last(rows, "ordinal")


def _state(spark, d):
    """Event table after the first part of the history."""
    empty = spark.createDataFrame([], lifecycle.schemas.EVENTS)
    return lifecycle.reconcile(
        empty, bulletin(spark, d, late=False), lifecycle.utc(BORN)
    ).drop("action")


def dedupe_last(spark, d):
    rows = poll_rows(spark, d).select(*lifecycle.KEY, "poll_no", "ordinal", "k", "event_type")
    return lifecycle.dedupe_last(rows, "ordinal", [*lifecycle.KEY, "poll_no"])


LAST_SQL = """last AS (SELECT source, external_id, poll_no, max(poll_ts) AS poll_ts,
  arg_max(k, ordinal) AS k, arg_max(event_type, ordinal) AS event_type
  FROM polls GROUP BY 1, 2, 3)"""

HALVES_SQL = f"""half AS (SELECT external_id || '-' || (k % 20) AS external_id,
  poll_no >= {SPLIT} AS late, arg_max(k, ordinal) AS k, arg_max(poll_ts, ordinal) AS t
  FROM polls GROUP BY 1, 2),
ab AS (SELECT *, CASE WHEN k % 4 = 0 THEN t + to_days(CAST(k % 25 AS INTEGER)) END AS e FROM half),
a AS (SELECT * FROM ab WHERE NOT late),
b AS (SELECT * FROM ab WHERE late)"""


def reconcile(spark, d):
    out = lifecycle.reconcile(
        _state(spark, d), bulletin(spark, d, late=True), lifecycle.utc(AT)
    )
    return out.select("external_id", "action", "ends_at", "attrs", "created_at", "updated_at")


RECONCILE_SQL = f"""WITH {POLLS_SQL}, {HALVES_SQL}
SELECT b.external_id, CASE WHEN a.k IS NULL THEN 'inserted' ELSE 'updated' END AS action,
  b.e AS ends_at, '{{"k":' || b.k || '}}' AS attrs,
  CASE WHEN a.k IS NULL THEN TIMESTAMP '2024-01-16' ELSE TIMESTAMP '2024-01-01' END AS created_at,
  TIMESTAMP '2024-01-16' AS updated_at
FROM b LEFT JOIN a USING (external_id)
WHERE a.k IS NULL OR a.k <> b.k OR a.e IS DISTINCT FROM b.e"""


def close_vanished(spark, d):
    state = _state(spark, d)
    out = lifecycle.close_vanished(
        state, state, bulletin(spark, d, late=True), lifecycle.utc(AT)
    )
    return out.select("external_id", "action", "ends_at", "created_at", "updated_at")


VANISHED_SQL = f"""WITH {POLLS_SQL}, {HALVES_SQL}
SELECT external_id, 'closed' AS action, TIMESTAMP '2024-01-16' AS ends_at,
  TIMESTAMP '2024-01-01' AS created_at, TIMESTAMP '2024-01-16' AS updated_at
FROM a WHERE (e IS NULL OR e > TIMESTAMP '2024-01-16')
  AND external_id NOT IN (SELECT external_id FROM b)"""


def close_events(spark, d):
    """Every later row names a closing of its key; the earliest decides."""
    closings = poll_rows(spark, d).where(F.col("poll_no") >= SPLIT).select(
        "source",
        F.concat_ws("-", "external_id", (F.col("k") % 20).cast("string")).alias("external_id"),
        F.col("poll_ts").alias("ended_at"),
    )
    out = lifecycle.close_events(_state(spark, d), closings, lifecycle.utc(AT))
    return out.select("external_id", "ends_at", "action")


CLOSE_SQL = f"""WITH {POLLS_SQL}, {HALVES_SQL},
c AS (SELECT external_id || '-' || (k % 20) AS external_id, min(poll_ts) AS t
      FROM polls WHERE poll_no >= {SPLIT} GROUP BY 1)
SELECT external_id, c.t AS ends_at, 'closed' AS action FROM a JOIN c USING (external_id)
WHERE e IS NULL OR e > c.t"""


def replay_polls(spark, d):
    return replay.replay_polls(poll_rows(spark, d), calendar(spark, d))


REPLAY_SQL = f"""WITH {POLLS_SQL}, {LAST_SQL},
cal AS (SELECT DISTINCT poll_no, poll_ts FROM polls),
m AS (SELECT *, lag(poll_no) OVER w AS p, lag(k) OVER w AS pk FROM last
      WINDOW w AS (PARTITION BY external_id ORDER BY poll_no)),
r AS (SELECT *, sum(CASE WHEN p = poll_no - 1 THEN 0 ELSE 1 END)
        OVER (PARTITION BY external_id ORDER BY poll_no) AS run,
        CASE WHEN p = poll_no - 1 AND pk <> k THEN 1 ELSE 0 END AS ch FROM m),
g AS (SELECT source, external_id, run, min(poll_no) AS a, max(poll_no) AS b, count(*) AS polls,
        CAST(sum(ch) AS BIGINT) AS changes FROM r GROUP BY 1, 2, 3)
SELECT source, external_id, a AS opened_no, c2.poll_no AS closed_no, c1.poll_ts AS opened_at,
  c2.poll_ts AS closed_at, polls, changes, run > 1 AS reopened
FROM g JOIN cal c1 ON c1.poll_no = a LEFT JOIN cal c2 ON c2.poll_no = b + 1"""


def change_counts(spark, d):
    return replay.replay_counts(poll_rows(spark, d), calendar(spark, d))


COUNTS_SQL = f"""WITH {POLLS_SQL}, {LAST_SQL},
cal AS (SELECT DISTINCT source, poll_no, poll_ts FROM polls),
m AS (SELECT *, lag(poll_no) OVER w AS p, lead(poll_no) OVER w AS n, lag(k) OVER w AS pk FROM last
      WINDOW w AS (PARTITION BY external_id ORDER BY poll_no)),
acts AS (SELECT poll_no, CASE WHEN p IS NULL THEN 'inserted'
                              WHEN p < poll_no - 1 OR pk <> k THEN 'updated' END AS act FROM m
         UNION ALL SELECT poll_no + 1, 'closed' FROM m
         WHERE n IS NULL OR n > poll_no + 1)
SELECT source, cal.poll_no, poll_ts, count(*) FILTER (act = 'inserted') AS inserted,
  count(*) FILTER (act = 'updated') AS updated, count(*) FILTER (act = 'closed') AS closed
FROM cal LEFT JOIN acts USING (poll_no) GROUP BY 1, 2, 3"""


def last_bulletin(spark, d):
    return lifecycle.last_bulletin(polls(spark, d))


def messages(spark, d):
    """Warning messages out of the event stream: purchases update, errors cancel, and each names
    the three identifiers before its own."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("ordinal"),
        F.concat(F.lit("cap-"), i.cast("string")).alias("external_id"),
        F.when(F.col("event_type") == "purchase", "Update")
        .when(F.col("event_type") == "error", "Cancel")
        .otherwise("Alert")
        .alias("msg_type"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("sent"),
        F.when(
            F.col("event_type").isin("purchase", "error"),
            F.transform(
                F.sequence(F.lit(1), F.lit(3)),
                lambda j: F.concat(F.lit("cap-"), (i - i % 7 - j).cast("string")),
            ),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("references"),
    )


def close_superseded(spark, d):
    m = messages(spark, d)
    rows = m.where(F.col("msg_type") != "Cancel").select(
        F.lit("aemet").alias("source"),
        "external_id",
        F.lit("weather_warning").alias("hazard_type"),
        F.lit(None).cast(lifecycle.schemas.GEOMETRY).alias("geom"),
        F.lit(2).cast("smallint").alias("severity"),
        F.col("sent").alias("starts_at"),
        F.when(F.col("ordinal") % 3 != 0, F.col("sent") + F.make_dt_interval(hours=F.col("ordinal") % 9))
        .alias("ends_at"),
        F.lit("{}").alias("attrs"),
        F.col("external_id").alias("content_hash"),
    )
    empty = spark.createDataFrame([], lifecycle.schemas.EVENTS)
    state = lifecycle.reconcile(empty, rows, lifecycle.utc(BORN)).drop("action")
    out = lifecycle.close_superseded(state, m, lifecycle.utc(AT))
    return out.select("external_id", "ends_at", "action", "closings")


SUPERSEDED_SQL = """WITH m AS (SELECT event_id AS ordinal, event_type, date_trunc('hour', ts) AS sent
  FROM events),
st AS (SELECT ordinal, CASE WHEN ordinal % 3 <> 0
         THEN sent + to_hours(CAST(ordinal % 9 AS INTEGER)) END AS e
       FROM m WHERE event_type <> 'error'),
src AS (SELECT ordinal, sent FROM m WHERE event_type IN ('purchase', 'error')),
turn AS (SELECT sent, min(ordinal) AS turn FROM src GROUP BY 1),
named AS (SELECT DISTINCT ordinal - ordinal % 7 - j AS target, sent
          FROM src, (SELECT unnest([1, 2, 3]) AS j)),
steps AS (SELECT target, sent, turn, e,
            least(min(sent) OVER (PARTITION BY target ORDER BY turn
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), e) AS reached
          FROM named JOIN turn USING (sent) JOIN st ON st.ordinal = target)
SELECT 'cap-' || target AS external_id, min(sent) AS ends_at, 'closed' AS action,
  count(*) FILTER (reached IS NULL OR reached > sent) AS closings
FROM steps GROUP BY target HAVING max(e) IS NULL OR min(sent) < max(e)"""


def poll_log(spark, d):
    """Every event is a poll attempt of one of four sources; errors are the failed ones. The last
    days of one source hold failures only."""
    e = table(spark, d, "events")
    n = F.col("user_id") % 4
    ok = (F.col("event_type") != "error") & ~(
        (n == 1) & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))
    )
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("poll_id"),
        F.element_at(
            F.array(F.lit("effis"), F.lit("ign"), F.lit("aemet"), F.lit("extra")), (n + 1).cast("int")
        ).alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
        ok.alias("ok"),
        F.when(~ok, F.concat(F.lit("failed "), F.repeat(F.lit("x"), k * 10))).alias("err"),
        F.when(ok & (F.col("event_type") == "purchase"), k.cast("string")).alias("cursor"),
    )


LOG_SQL = """
lg AS (SELECT event_id, ['effis', 'ign', 'aemet', 'extra'][user_id % 4 + 1] AS source, ts,
  event_type <> 'error' AND NOT (user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-29') AS ok,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events),
st AS (SELECT source, max(ts) AS last_run_at, max(ts) FILTER (ok) AS last_success_at,
  CAST(arg_max(k, ts) FILTER (ok AND event_type = 'purchase') AS VARCHAR) AS cursor
  FROM lg GROUP BY 1),
fl AS (SELECT source, count(*) AS n, substr(arg_max('failed ' || repeat('x', k * 10), ts), 1, 500) AS e
  FROM lg JOIN st USING (source) WHERE NOT ok AND (last_success_at IS NULL OR ts > last_success_at)
  GROUP BY 1),
state AS (SELECT source, last_run_at, last_success_at, cursor, e AS last_error,
  CAST(coalesce(n, 0) AS INTEGER) AS consecutive_failures FROM st LEFT JOIN fl USING (source))"""


def sync_state(spark, d):
    return status.sync_state(poll_log(spark, d), error_chars=500)


def source_status(spark, d):
    # One more job than there are sources in the log, as a source that never ran.
    jobs = status.cadence(spark, (*status.CADENCE, ("sensor_sync", 600), ("cleanup", 60)))
    return status.source_status(status.sync_state(poll_log(spark, d)), jobs, AS_OF)


STATUS_SQL = f"""WITH {LOG_SQL},
jobs AS (SELECT * FROM (VALUES ('effis', 14400), ('ign', 900), ('aemet', 1800), ('sensor', 600))
         AS t(source, interval_seconds)),
j AS (SELECT source, last_run_at, last_success_at,
  date_diff('microsecond', last_success_at, TIMESTAMP '2024-01-31 02:00:00') / 1e6
    AS seconds_since_success,
  coalesce(consecutive_failures, 0) AS consecutive_failures,
  coalesce(last_error, '') <> '' AS has_error, CAST(interval_seconds AS INTEGER) AS interval_seconds
  FROM state FULL OUTER JOIN jobs USING (source)),
s AS (SELECT *, interval_seconds IS NOT NULL AND (seconds_since_success IS NULL
        OR seconds_since_success > 3 * interval_seconds) AS stale FROM j)
SELECT *, NOT stale AND consecutive_failures < 3 AS healthy FROM s"""


def overall_status(spark, d):
    return status.overall_status(source_status(spark, d))


QUERIES = {
    "dedupe_last": dedupe_last,
    "reconcile": reconcile,
    "close_events": close_events,
    "close_vanished": close_vanished,
    "close_superseded": close_superseded,
    "replay_polls": replay_polls,
    "change_counts": change_counts,
    "last_bulletin": last_bulletin,
    "sync_state": sync_state,
    "source_status": source_status,
    "overall_status": overall_status,
}

ORACLES = {
    "dedupe_last": f"""WITH {POLLS_SQL}, {LAST_SQL}
SELECT source, external_id, poll_no, k, event_type FROM last""",
    "reconcile": RECONCILE_SQL,
    "close_events": CLOSE_SQL,
    "close_vanished": VANISHED_SQL,
    "close_superseded": SUPERSEDED_SQL,
    "replay_polls": REPLAY_SQL,
    "change_counts": COUNTS_SQL,
    "last_bulletin": f"""WITH {POLLS_SQL}
SELECT DISTINCT source, external_id FROM polls
WHERE poll_no = (SELECT max(poll_no) FROM polls)""",
    "sync_state": f"WITH {LOG_SQL} SELECT * FROM state",
    "source_status": STATUS_SQL,
    "overall_status": STATUS_SQL.replace(
        "SELECT *, NOT stale AND consecutive_failures < 3 AS healthy FROM s",
        """SELECT CASE WHEN bool_and(NOT stale AND consecutive_failures < 3) THEN 'ok'
  ELSE 'degraded' END AS status, count(*) AS sources FROM s""",
    ),
}
