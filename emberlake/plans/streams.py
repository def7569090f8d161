"""Sync streams over weekly polls rendered from the given tables, and what they leave behind."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.functions import values
from emberlake.operators import status
from emberlake.plans.carriers import hazards, hazards_sql, derive_hazards, polls, table
from emberlake.plans.feeds import _element, _named_value
from emberlake.session import apply_runtime_conf, shared_folder
from emberlake.sources import feeds, snapshot
from emberlake.streaming import sync

UTC = dt.timezone.utc
DAYS = 7
# Reports per fire document, by running number: a document stays small whoever reports most.
PER_DOC = 500
START = dt.datetime(2024, 1, 1, tzinfo=UTC)

_ROOTS: dict[tuple[str, str, str], str] = {}


def _poll_ts(week: int) -> dt.datetime:
    return START + dt.timedelta(days=DAYS * (week + 1))


def _weeks(spark, d) -> int:
    """Weekly polls that hold all days of the table."""
    return polls(spark, d).agg(F.floor(F.max("poll_no") / DAYS)).first()[0] + 1


def _run(spark, d, name, land, start) -> str:
    """Land the polls and run the stream once per application and table folder."""
    apply_runtime_conf(spark)
    slot = (spark.sparkContext.applicationId, os.path.abspath(d), name)
    if slot not in _ROOTS:
        folder = shared_folder(spark, name)
        land(spark, d, f"{folder}/landed")
        start(spark, f"{folder}/landed", f"{folder}/store")
        _ROOTS[slot] = f"{folder}/store"
    return _ROOTS[slot]


# --- fires: the day polls of a week make one bulletin ----------------------------------------


def _fire_documents(spark, d, week: int):
    """Both layers of one weekly poll. A fire is a (user, k % 20); ``k`` is its content, and a
    fire reported twice in a week comes last with its latest."""
    rows = polls(spark, d).where(F.floor(F.col("poll_no") / DAYS) == week)
    # reports are many times as long as their rows, so these meet before they are rendered
    rows = rows.withColumn("chunk", F.floor(F.col("ordinal") / PER_DOC)).repartition("chunk")
    user = F.substring("external_id", 4, 18).cast("bigint")
    r = F.col("k") % 20
    key = F.concat_ws("-", user.cast("string"), r.cast("string"))
    lat, lon = 36 + user % 8, -9 + r % 12

    def pair(y, x):
        return F.concat(F.lit("["), y.cast("string"), F.lit(","), x.cast("string"), F.lit("]"))

    spot = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"'), key,
        F.lit('","acq_at":"2024-01-01 00:00:00","CLASS":"C'), F.col("k").cast("string"),
        F.lit('"},"geometry":{"type":"Point","coordinates":'), pair(lat, lon), F.lit("}}"),
    )
    corners = [pair(lat, lon), pair(lat, lon + 1), pair(lat + 1, lon + 1), pair(lat, lon)]
    area = F.concat(
        F.lit('{"type":"Feature","properties":{"id":"1","fire_id":"'), key,
        F.lit('","initialdate":"2024-01-01 00:00:00","finaldate":"","area":"'),
        (F.col("k") * 10 + 1).cast("string"),
        F.lit('"},"geometry":{"type":"Polygon","coordinates":[['), F.concat_ws(",", *corners), F.lit("]]}}"),
    )
    hot = user % 3 == 0
    pieces = rows.select(
        "chunk",
        F.when(hot, "hotspots").otherwise("burnt_areas").alias("layer"),
        F.struct("ordinal", F.when(hot, spot).otherwise(area).alias("text")).alias("piece"),
    )
    body = F.array_join(F.transform(F.sort_array("pieces"), lambda p: p["text"]), ",")
    return (
        pieces.groupBy("chunk", "layer")
        .agg(F.collect_list("piece").alias("pieces"))
        .select(
            F.concat_ws("-", "layer", F.lpad(F.col("chunk").cast("string"), 9, "0")).alias("doc_id"),
            "layer",
            F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("payload"),
        )
    )


def _land_fires(spark, d, landed):
    """Every weekly poll is followed by one that must not be applied: even ones with a document cut short, odd ones
    without a layer."""
    for week in range(_weeks(spark, d)):
        documents = _fire_documents(spark, d, week)
        sync.land_poll(documents, landed, f"week-{week}", _poll_ts(week), spark)
        if week % 2:
            broken = documents.where(F.col("layer") == "hotspots")
        else:
            first = documents.agg(F.min("doc_id")).first()[0]
            cut = F.substring("payload", F.lit(1), F.length("payload") - 9)
            payload = F.when(F.col("doc_id") == first, cut).otherwise(F.col("payload"))
            broken = documents.withColumn("payload", payload)
        sync.land_poll(broken, landed, f"broken-{week}", _poll_ts(week) + dt.timedelta(hours=1), spark)


def _fire_store(spark, d):
    return _run(spark, d, "fires", _land_fires, _sync_all_fires)


def _sync_all_fires(spark, landed, root):
    sync.sync_wildfires(spark, landed, root, skip_refused=True)


def refused_polls(spark, d):
    """The polls the fire stream set aside."""
    return sync.refused_polls(spark, _fire_store(spark, d))


def sync_wildfires(spark, d):
    """Event table after the weekly fire polls."""
    rows = sync.events(spark, _fire_store(spark, d), ["severity", "starts_at", "ends_at", "attrs", "created_at"])
    attrs = F.col("attrs")
    return rows.select(
        "external_id", "severity", "starts_at", "ends_at",
        values.attr(attrs, "kind").alias("kind"),
        F.coalesce(values.attr(attrs, "class"), values.attr(attrs, "area_ha")).alias("content"),
        "created_at",
    )


FIRES_SQL = f"""polls AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {DAYS} AS wk FROM events),
last AS (SELECT user_id || '-' || (k % 20) AS key, user_id % 3 = 0 AS hot, wk, arg_max(k, event_id) AS k
  FROM polls GROUP BY 1, 2, 3),
fin AS (SELECT key, hot, arg_max(k, wk) AS k, max(wk) AS wk, min(wk) AS born FROM last GROUP BY 1, 2)"""


def _week_sql(expr: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_days(CAST({DAYS} * ({expr} + 1) AS INTEGER))"


FIRE_STATE_SQL = f"""WITH {FIRES_SQL}
SELECT CASE WHEN hot THEN 'hs-' ELSE 'ba-' END || key AS external_id,
  CAST(CASE WHEN NOT hot AND k * 10 + 1 >= 500 THEN 3 ELSE 2 END AS SMALLINT) AS severity,
  TIMESTAMP '2024-01-01' AS starts_at,
  CASE WHEN hot THEN TIMESTAMP '2024-01-01' WHEN wk < (SELECT max(wk) FROM polls) THEN {_week_sql('wk + 1')}
  END AS ends_at,
  CASE WHEN hot THEN 'hotspot' ELSE 'burnt_area' END AS kind,
  CASE WHEN hot THEN 'C' || k ELSE (k * 10 + 1) || '.0' END AS content,
  {_week_sql('born')} AS created_at
FROM fin"""


def change_log(spark, d):
    """Change notices of the fire stream, one per poll that changed anything."""
    return sync.change_log(spark, _fire_store(spark, d))


CHANGES_SQL = f"""WITH {FIRES_SQL},
m AS (SELECT *, lag(wk) OVER w AS p, lead(wk) OVER w AS n, lag(k) OVER w AS pk FROM last
      WINDOW w AS (PARTITION BY key, hot ORDER BY wk)),
acts AS (SELECT wk, CASE WHEN p IS NULL THEN 'inserted'
                         WHEN pk <> k OR (NOT hot AND p < wk - 1) THEN 'updated' END AS act FROM m
         UNION ALL SELECT wk + 1, 'closed' FROM m
         WHERE NOT hot AND (n IS NULL OR n > wk + 1) AND wk < (SELECT max(wk) FROM polls))
SELECT 2 * wk AS batch_id, 'effis' AS source, count(*) FILTER (act = 'inserted') AS inserted,
  count(*) FILTER (act = 'updated') AS updated, count(*) FILTER (act = 'closed') AS closed
FROM acts WHERE act IS NOT NULL GROUP BY 1"""


def stream_sync_state(spark, d):
    """Sync state of the fire stream, kept up with each poll."""
    return sync.sync_state(spark, _fire_store(spark, d)).select(
        "source", "last_run_at", "last_success_at", "consecutive_failures"
    )


def stream_snapshot(spark, d):
    """Newest snapshot the fire stream left, by the standard reader."""
    rows = snapshot.read_snapshot(spark, f"{_fire_store(spark, d)}/snapshot")
    return rows.groupBy("hazard_type", "severity").agg(
        F.count("*").alias("events"), F.count("ends_at").alias("ended")
    )


# --- quakes: each is served in two polls, every fifth revised in the second --------------------

QUAKE_POLLS = 5


def _quake_documents(spark, d, poll: int):
    k = F.col("o_orderkey")
    again = k % 4 == poll - 1
    tenths = 10 + (k * 13) % 50 + F.when(again & (k % 5 == 0), 7).otherwise(0)
    text = F.concat(
        F.lit("terremoto de magnitud "), F.floor(tenths / 10).cast("string"), F.lit("."),
        (tenths % 10).cast("string"), F.lit(" en MAR "), (k % 9).cast("string"), F.lit(" en la fecha "),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "dd/MM/yyyy"), F.lit(" 12:00:00 en"),
    )
    item = _element(
        "item",
        F.concat(
            _element("description", text),
            _element("guid", F.concat(F.lit("http://www.example.org/x?evid=es"), k.cast("string"))),
            _element("geo:lat", (36 + k % 7).cast("string")),
            _element("geo:long", (-9 + k % 11).cast("string")),
        ),
    )
    rows = table(spark, d, "orders").where((k % 4 == poll) | again)
    # items are many times as long as their rows, so these meet before they are rendered
    rows = rows.withColumn("chunk", F.floor(k / 600)).repartition("chunk")
    return (
        rows.select("chunk", F.struct(k.alias("k"), item.alias("text")).alias("piece"))
        .groupBy("chunk")
        .agg(F.collect_list("piece").alias("pieces"))
        .select(
            F.lpad(F.col("chunk").cast("string"), 9, "0").alias("doc_id"),
            F.lit("quakes").alias("layer"),
            F.concat(
                F.lit('<rss xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#"><channel>'),
                F.array_join(F.transform(F.sort_array("pieces"), lambda p: p["text"]), ""),
                F.lit("</channel></rss>"),
            ).alias("payload"),
        )
    )


def _land_quakes(spark, d, landed):
    for poll in range(QUAKE_POLLS):
        sync.land_poll(_quake_documents(spark, d, poll), landed, f"poll-{poll}", _poll_ts(poll), spark)
    sync.land_poll(None, landed, "poll-down", _poll_ts(QUAKE_POLLS), spark, err="unreachable")


def _quake_store(spark, d):
    return _run(spark, d, "quakes", _land_quakes, sync.sync_quakes)


def sync_quakes(spark, d):
    """Quake counts per change notice next to the final table, by strength."""
    kept = ["severity", "starts_at", "ends_at", "attrs", "created_at", "updated_at"]
    rows = sync.events(spark, _quake_store(spark, d), kept)
    return rows.select(
        "external_id", "severity", "starts_at", "ends_at",
        values.attr_double(F.col("attrs"), "magnitude").alias("magnitude"),
        "created_at", "updated_at",
    )


QUAKES_SQL = f"""WITH q AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS revised,
  10 + (o_orderkey * 13) % 50 + CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 0 END AS tenths,
  o_orderdate + CASE WHEN o_orderdate >= s AND o_orderdate <
      e THEN INTERVAL 10 HOUR ELSE INTERVAL 11 HOUR END AS t
  FROM (SELECT *, last_day(make_date(CAST(year(o_orderdate) AS INTEGER), 3, 1)) - CAST(dayofweek(
          last_day(make_date(CAST(year(o_orderdate) AS INTEGER), 3, 1))) AS INTEGER) AS s,
        last_day(make_date(CAST(year(o_orderdate) AS INTEGER), m, 1)) - CAST(dayofweek(
          last_day(make_date(CAST(year(o_orderdate) AS INTEGER), m, 1))) AS INTEGER) AS e
        FROM (SELECT *, CASE WHEN year(o_orderdate) = 1995 THEN 9 ELSE 10 END AS m FROM orders)))
SELECT 'es' || k AS external_id, CAST(CASE WHEN tenths >= 55 THEN 4 WHEN tenths >= 40 THEN 3
    WHEN tenths >= 30 THEN 2 ELSE 1 END AS SMALLINT) AS severity,
  t AS starts_at, t AS ends_at, tenths / 10.0::DOUBLE AS magnitude,
  {_week_sql('k % 4')} AS created_at,
  {_week_sql('k % 4 + CASE WHEN revised THEN 1 ELSE 0 END')} AS updated_at FROM q"""


def quake_source_status(spark, d):
    """Sync state of the quake stream: the last attempt failed, the cursor is kept."""
    return status.sync_state(sync.poll_log(spark, _quake_store(spark, d)))


QUAKE_STATE_SQL = f"""WITH s AS ({QUAKES_SQL})
SELECT 'ign' AS source, {_week_sql(str(QUAKE_POLLS))} AS last_run_at,
  {_week_sql(str(QUAKE_POLLS - 1))} AS last_success_at,
  strftime((SELECT max(starts_at) FROM s WHERE CAST(substr(external_id, 3) AS BIGINT) % 4 = 3),
           '%Y-%m-%d %H:%M:%S') AS cursor,
  'unreachable' AS last_error, CAST(1 AS INTEGER) AS consecutive_failures"""


# --- warnings: even ones are served for two weeks ----------------------------------------------


def _warning_documents(spark, d, week: int):
    e = table(spark, d, "events")
    i = F.col("event_id")
    own = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / DAYS)
    served = (own == week) | ((own == week - 1) & (i % 2 == 0))
    sent = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    kind = (
        F.when(F.col("event_type") == "purchase", "Update")
        .when(F.col("event_type") == "error", "Cancel")
        .otherwise("Alert")
    )

    def moment(c):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-00:00"))

    refs = F.concat_ws(
        " ", *[F.concat(F.lit("s,cap-"), (i - i % 7 - j).cast("string"), F.lit(",t")) for j in (1, 2, 3)]
    )
    info = _element(
        "info",
        F.concat(
            _element("language", F.lit("es-ES")),
            _element("onset", moment(sent)),
            _element("expires", moment(sent + F.make_dt_interval(hours=(i % 400).cast("int")))),
            _named_value("parameter", feeds.NAME_LEVEL, F.lit("rojo")),
            _element(
                "area", _element("polygon", F.lit("41.0,-2.0 41.5,-2.0 41.5,-1.5 41.0,-2.0"))
            ),
        ),
    )
    body = F.concat(
        _element("identifier", F.concat(F.lit("cap-"), i.cast("string"))),
        _element("sent", moment(sent)),
        _element("msgType", kind),
        F.when(kind != "Alert", _element("references", refs)).otherwise(""),
        F.when(kind != "Cancel", info).otherwise(""),
    )
    # a file of short rows makes few tasks, and the messages are many times as long
    return e.where(served).repartition("event_id").select(
        F.lpad(i.cast("string"), 12, "0").alias("doc_id"),
        F.lit("warnings").alias("layer"),
        F.concat(F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'), body, F.lit("</alert>")).alias(
            "payload"
        ),
    )


def _land_warnings(spark, d, landed):
    for week in range(_weeks(spark, d)):
        sync.land_poll(_warning_documents(spark, d, week), landed, f"week-{week}", _poll_ts(week), spark)


def sync_warnings(spark, d):
    """Warning table after the weekly bulletins: windows cut by successors and by withdrawal."""
    root = _run(spark, d, "warnings", _land_warnings, sync.sync_warnings)
    kept = ["external_id", "starts_at", "ends_at", "created_at"]
    return sync.events(spark, root, kept).select(*kept)


WARNINGS_SQL = f"""WITH m AS (SELECT event_id AS i, event_type, date_trunc('hour', ts) AS sent,
  date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {DAYS} AS w FROM events),
b AS (SELECT *, least(w + CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END, (SELECT max(w) FROM m)) AS last FROM m),
refs AS (SELECT i - i % 7 - j AS target, sent, last FROM b, (SELECT unnest([1, 2, 3]) AS j)
         WHERE event_type IN ('purchase', 'error'))
SELECT 'cap-' || b.i AS external_id, b.sent AS starts_at,
  least(b.sent + to_hours(CAST(b.i % 400 AS INTEGER)),
        min(refs.sent) FILTER (refs.last >= b.last),
        CASE WHEN b.last < (SELECT max(w) FROM m) THEN {_week_sql('b.last + 1')} END) AS ends_at,
  {_week_sql('b.w')} AS created_at
FROM b LEFT JOIN refs ON refs.target = b.i WHERE b.event_type <> 'error'
GROUP BY b.i, b.sent, b.last, b.w"""


# --- snapshots ---------------------------------------------------------------------------------


def write_snapshot(spark, d):
    """Two versions of a snapshot, the first of quakes only; readers follow the newest."""
    root = shared_folder(spark, "versions")
    rows = derive_hazards(spark, d).select(*schemas.SNAPSHOT.fieldNames())
    snapshot.write_snapshot(rows.where(F.col("source") == "ign"), root, version=1)
    snapshot.write_snapshot(rows, root, version=2)
    return snapshot.read_snapshot(spark, root).select(
        "id", "source", "severity", "starts_at", "ends_at", "attrs",
        F.size(F.col("geom.parts")).alias("parts"),
    )


def read_snapshot(spark, d):
    """Events per source out of the stored snapshot, next to a snapshot that does not exist."""
    missing = snapshot.read_snapshot(spark, shared_folder(spark, "nowhere"))
    stored = hazards(spark, d).select(*schemas.SNAPSHOT.fieldNames())
    return stored.unionByName(missing).select("id", "hazard_type", "external_id", "starts_at")


HZ = hazards_sql()

QUERIES = {
    "sync_wildfires": sync_wildfires,
    "change_log": change_log,
    "refused_polls": refused_polls,
    "stream_sync_state": stream_sync_state,
    "stream_snapshot": stream_snapshot,
    "sync_quakes": sync_quakes,
    "quake_source_status": quake_source_status,
    "sync_warnings": sync_warnings,
    "write_snapshot": write_snapshot,
    "read_snapshot": read_snapshot,
}

ORACLES = {
    "sync_wildfires": FIRE_STATE_SQL,
    "change_log": CHANGES_SQL,
    "stream_sync_state": f"""WITH {FIRES_SQL} SELECT 'effis' AS source, {_week_sql('max(wk)')} AS last_run_at,
  {_week_sql('max(wk)')} AS last_success_at, CAST(0 AS INTEGER) AS consecutive_failures FROM polls""",
    "refused_polls": f"""WITH {FIRES_SQL} SELECT DISTINCT 'broken-' || wk AS poll_id, 'effis' AS source,
  CASE WHEN wk % 2 = 1 THEN 'a layer has no document' ELSE 'a document cannot be read' END AS reason FROM polls""",
    "stream_snapshot": f"""WITH s AS ({FIRE_STATE_SQL}) SELECT 'wildfire' AS hazard_type, severity,
  count(*) AS events, count(ends_at) AS ended FROM s GROUP BY 2""",
    "sync_quakes": QUAKES_SQL,
    "quake_source_status": QUAKE_STATE_SQL,
    "sync_warnings": WARNINGS_SQL,
    "write_snapshot": f"""WITH {HZ} SELECT id, source, severity, starts_at, ends_at, attrs,
  CAST(CASE WHEN source = 'effis' AND key % 12 = 9 THEN 2 ELSE 1 END AS INTEGER) AS parts FROM hz""",
    "read_snapshot": f"WITH {HZ} SELECT id, hazard_type, external_id, starts_at FROM hz",
}
