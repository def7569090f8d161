"""Feed documents rendered from the given tables, and the records read back from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.functions import geometry, values
from emberlake.operators import grid
from emberlake.operators.filters import ingestible_warnings as fit_warnings
from emberlake.plans.carriers import POLLS_SQL, polls, table
from emberlake.sources import feeds

# Orders per document. Document numbers divisible by these are unreadable or empty.
PER_DOC = 90
BROKEN, EMPTY = 11, 13


def _orders(spark, d):
    """Keys and moments, spread over all tasks: rendering and parsing text is the costly part."""
    return table(spark, d, "orders").repartition(
        spark.sparkContext.defaultParallelism, "o_orderkey"
    ).select(
        F.col("o_orderkey").alias("key"),
        (
            F.col("o_orderdate").cast("timestamp")
            + F.make_dt_interval(hours=F.col("o_orderkey") % 24, mins=F.col("o_orderkey") % 60)
        ).alias("at"),
    )


def _degrees(milli: Column) -> Column:
    """Decimal text of milli-degrees."""
    size = F.abs(milli)
    return F.concat(
        F.when(milli < 0, "-").otherwise(""),
        F.floor(size / 1000).cast("string"),
        F.lit("."),
        F.lpad((size % 1000).cast("string"), 3, "0"),
    )


def _lon(k: Column) -> Column:
    return -9500 + (k * 7919) % 12900


def _lat(k: Column) -> Column:
    return 36000 + (k * 104729) % 7800


def _element(name: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))


def _documents(rows, head: str, glue: str, tail: str):
    """One document per PER_DOC orders, its pieces in key order; some are cut short or empty."""
    n = F.col("doc")
    body = F.when(n % EMPTY == 0, F.lit("")).otherwise(
        F.array_join(F.transform(F.sort_array("pieces"), lambda p: p["piece"]), glue)
    )
    whole = F.concat(F.lit(head), body, F.lit(tail))
    return (
        rows.groupBy(F.floor(F.col("key") / PER_DOC).alias("doc"))
        .agg(F.collect_list(F.struct("key", "piece")).alias("pieces"))
        .select(
            n.cast("string").alias("poll_id"),
            F.concat(F.lit("doc-"), n.cast("string")).alias("doc_id"),
            F.when(n % BROKEN == 0, F.substring(whole, F.lit(1), F.length(whole) - 20))
            .otherwise(whole)
            .alias("payload"),
        )
    )


def quake_documents(spark, d):
    """GeoRSS feeds of all orders; the order's moment is the local time. Wordings vary: words repeated elsewhere, line breaks,
    regions that hold the words around them."""
    k = F.col("key")
    odd, way = F.floor(k / 3) % 40, k % 5
    magnitude = F.concat(F.floor((10 + (k * 13) % 60) / 10).cast("string"), F.lit("."),
                         ((10 + (k * 13) % 60) % 10).cast("string"), F.when(odd == 6, F.lit(".4")).otherwise(""))
    page = F.lit("http://www.example.org/web/quake/detail")
    link = F.concat(page, F.when(odd != 0, F.concat(F.lit("?evid=es"), k.cast("string"))).otherwise(""))
    text = F.concat(
        F.when(way == 1, "aviso: magnitud revisada en la fecha de hoy. ").otherwise("Registrado un "),
        F.lit("terremoto de "),
        F.when(odd == 3, "intensidad").otherwise("magnitud"), F.when(way == 2, "\n").otherwise(" "), magnitude,
        F.when(way == 3, "\t en\n").otherwise(" en "), _quake_region(k),
        F.when(way == 2, "\u00a0en la fecha\n").otherwise(" en la fecha "),
        F.date_format("at", "dd/MM/yyyy"), F.when(way == 3, "\n").otherwise(" "),
        F.date_format("at", "H:mm"), F.when(odd == 7, "").otherwise(F.date_format("at", ":ss")),
        F.lit(" en la siguiente localización"),
    )
    lat = F.when(odd == 1, F.lit("96.5")).otherwise(_degrees(_lat(k)))
    lon = F.when(odd == 2, F.lit("nan")).when(odd == 5, F.lit("1e999")).otherwise(_degrees(_lon(k)))
    item = _element(
        "item",
        F.concat(
            _element("title", F.lit("Parte de prueba")),
            _element("link", link),
            _element("description", text),
            F.when(odd != 4, _element("guid", link)).otherwise(""),
            _element("geo:lat", lat),
            _element("geo:long", lon),
        ),
    )
    rows = _orders(spark, d).select("key", item.alias("piece"))
    return _documents(
        rows,
        '<?xml version="1.0" encoding="UTF-8"?><rss xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#" '
        'version="2.0"><channel><title>Sismos</title>',
        "",
        "</channel></rss>",
    )


def _quake_region(k: Column) -> Column:
    extra = F.when(k % 5 == 4, " en la fecha prevista").otherwise("")
    return F.concat(F.lit("COMARCA "), (k % 7).cast("string"), extra, F.lit(" NORTE"))


def ingest_quakes(spark, d):
    good, _, _ = feeds.split_malformed(feeds.ingest_quakes(quake_documents(spark, d)))
    return good.select(
        "poll_id", "external_id", "magnitude", "region", "raw_local_moment", "occurred_at",
        F.round(F.col("latitude") * 1000).cast("bigint").alias("lat_m"),
        F.round(F.col("longitude") * 1000).cast("bigint").alias("lon_m"),
    )


def split_malformed(spark, d):
    """Verdict per poll of the quake feed."""
    _, _, gate = feeds.split_malformed(feeds.ingest_quakes(quake_documents(spark, d)))
    return gate


ORD = """o AS (SELECT o_orderkey AS key, o_orderkey // 90 AS doc,
  o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))
              + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS t0,
  -9500 + (o_orderkey * 7919) % 12900 AS lon_m, 36000 + (o_orderkey * 104729) % 7800 AS lat_m
  FROM orders)"""
READABLE = f"doc % {BROKEN} <> 0 AND doc % {EMPTY} <> 0"


def _last_sunday(month: str) -> str:
    return (
        f"(last_day(make_date(CAST(year(t0) AS INTEGER), {month}, 1)) - CAST(dayofweek("
        f"last_day(make_date(CAST(year(t0) AS INTEGER), {month}, 1))) AS INTEGER))"
    )


# Summer time by local clock: from 03:00 of March's last Sunday to 03:00 of the last Sunday of
# October, of September in 1995.
SUMMER = (
    f"(t0 >= {_last_sunday('3')} + INTERVAL 3 HOUR AND t0 < "
    f"CASE WHEN year(t0) = 1995 THEN {_last_sunday('9')} ELSE {_last_sunday('10')} END "
    "+ INTERVAL 3 HOUR)"
)

QUAKES_SQL = f"""WITH {ORD}
SELECT CAST(doc AS VARCHAR) AS poll_id, 'es' || key AS external_id,
  (10 + (key * 13) % 60) / 10.0::DOUBLE AS magnitude, 
  'COMARCA ' || (key % 7) || CASE WHEN key % 5 = 4 THEN ' en la fecha prevista' ELSE '' END || ' NORTE' AS region,
  strftime(t0, '%d/%m/%Y ') || hour(t0) || strftime(t0, ':%M:%S') AS raw_local_moment,
  t0 - CASE WHEN {SUMMER} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS occurred_at,
  lat_m, lon_m
FROM o WHERE {READABLE} AND (key // 3) % 40 NOT IN (0, 1, 2, 3, 5, 6, 7)"""

GATE_SQL = f"""WITH {ORD}, q AS (SELECT *, (key // 3) % 40 AS odd FROM o),
g AS (SELECT doc, CASE WHEN doc % {BROKEN} = 0 THEN 1 WHEN doc % {EMPTY} = 0 THEN 0
                       ELSE count(*) END AS units,
  CASE WHEN {READABLE} THEN count(*) FILTER (odd NOT IN (0, 1, 2, 3, 5, 6, 7)) ELSE 0 END AS good
  FROM q GROUP BY doc)
SELECT CAST(doc AS VARCHAR) AS poll_id, units, good,
  CASE WHEN units = 0 THEN 'empty' WHEN good = 0 THEN 'failed' ELSE 'ok' END AS verdict FROM g"""


def _feature(properties: Column, kind: Column, coordinates: Column) -> Column:
    return F.concat(
        F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), kind,
        F.lit('","coordinates":'), coordinates, F.lit("}}"),
    )


COLLECTION = ('{"type":"FeatureCollection","features":[', ",", "]}")


def hotspot_documents(spark, d):
    k = F.col("key")
    odd = F.floor(k / 6) % 30
    moment = F.date_format("at", "yyyy-MM-dd HH:mm:ss")
    properties = F.to_json(
        F.struct(
            F.when(odd != 0, k.cast("string")).alias("id"),
            F.when(odd == 1, F.lit("yesterday")).otherwise(moment).alias("acq_at"),
            F.when(odd != 2, F.lit("7DAYS_N")).alias("CLASS"),
        )
    )
    lat = F.when(odd == 3, F.lit("142.5")).otherwise(_degrees(_lat(k)))
    pair = F.concat(F.lit("["), lat, F.lit(","), _degrees(_lon(k)), F.lit("]"))
    coordinates = F.when(odd == 4, F.lit("[]")).otherwise(pair)
    kind = F.when(odd == 5, "LineString").otherwise("Point")
    rows = _orders(spark, d).select(
        "key", _feature(properties, kind, coordinates).alias("piece")
    )
    return _documents(rows, *COLLECTION)


def ingest_hotspots(spark, d):
    good, _, _ = feeds.split_malformed(feeds.ingest_hotspots(hotspot_documents(spark, d)))
    return good.select(
        "poll_id", "external_id", "observed_at", "attrs",
        F.round(F.col("geom.minx") * 1000).cast("bigint").alias("lon_m"),
        F.round(F.col("geom.miny") * 1000).cast("bigint").alias("lat_m"),
    )


HOTSPOTS_SQL = f"""WITH {ORD}
SELECT CAST(doc AS VARCHAR) AS poll_id, 'hs-' || key AS external_id, t0 AS observed_at,
  '{{"product":"all.hs","class":"' || CASE WHEN (key // 6) % 30 = 2 THEN '' ELSE '7DAYS_N' END
    || '","raw_acquired_at":"' || strftime(t0, '%Y-%m-%d %H:%M:%S') || '","kind":"hotspot"}}' AS attrs,
  lon_m, lat_m
FROM o WHERE {READABLE} AND (key // 6) % 30 NOT IN (0, 1, 3, 4, 5)"""


def burnt_area_documents(spark, d):
    k = F.col("key")
    odd = F.floor(k / 6) % 30
    properties = F.to_json(
        F.struct(
            F.lit("1").alias("id"),
            F.when(odd != 0, k.cast("string")).alias("fire_id"),
            F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("initialdate"),
            F.when(odd != 1, F.date_format("at", "yyyy-MM-dd HH:mm:ss")).alias("finaldate"),
            F.when(odd == 2, "nan")
            .when(odd == 3, "1e999")
            .when(odd == 4, "-3")
            .when(odd == 5, "much")
            .otherwise((30 + (k * 37) % 6000).cast("string"))
            .alias("area"),
        )
    )
    x, y, h = _lon(k), _lat(k), 1 + k % 20

    def ring(x):
        corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
        pairs = [F.concat(F.lit("["), _degrees(b), F.lit(","), _degrees(a), F.lit("]")) for a, b in corners]
        return F.concat(F.lit("["), F.concat_ws(",", *pairs), F.lit("]"))

    twin = k % 12 == 9
    coordinates = (
        F.when(odd == 6, F.lit("[]"))
        .when(odd == 7, F.lit("[[]]"))
        .when(twin, F.concat(F.lit("[["), ring(x), F.lit("],["), ring(x + 4 * h), F.lit("]]")))
        .otherwise(F.concat(F.lit("["), ring(x), F.lit("]")))
    )
    kind = F.when(odd == 8, "Point").when(twin, "MultiPolygon").otherwise("Polygon")
    rows = _orders(spark, d).select(
        "key", _feature(properties, kind, coordinates).alias("piece")
    )
    return _documents(rows, *COLLECTION)


def ingest_burnt_areas(spark, d):
    good, _, _ = feeds.split_malformed(feeds.ingest_burnt_areas(burnt_area_documents(spark, d)))
    return good.select(
        "poll_id", "external_id", "observed_at", "area_ha", F.col("geom.kind").alias("kind"),
        F.get_json_object("attrs", "$.raw_finaldate").alias("raw_finaldate"),
        F.size(geometry.vertices(F.col("geom"))).alias("corners"),
        F.round(F.col("geom.minx") * 1000).cast("bigint").alias("west_m"),
        F.round(F.col("geom.maxx") * 1000).cast("bigint").alias("east_m"),
        F.round(F.col("geom.maxy") * 1000).cast("bigint").alias("north_m"),
    )


AREAS_SQL = f"""WITH {ORD}
SELECT CAST(doc AS VARCHAR) AS poll_id, 'ba-' || key AS external_id, t0 AS observed_at,
  CAST(30 + (key * 37) % 6000 AS DOUBLE) AS area_ha,
  CASE WHEN key % 12 = 9 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind,
  CASE WHEN (key // 6) % 30 = 1 THEN '' ELSE strftime(t0, '%Y-%m-%d %H:%M:%S') END AS raw_finaldate,
  CASE WHEN key % 12 = 9 THEN 10 ELSE 5 END AS corners,
  lon_m - 1 - key % 20 AS west_m,
  lon_m + (1 + key % 20) * CASE WHEN key % 12 = 9 THEN 5 ELSE 1 END AS east_m,
  lat_m + 1 + key % 20 AS north_m
FROM o WHERE {READABLE} AND (key // 6) % 30 NOT IN (0, 2, 3, 4, 5, 6, 7, 8)"""


def _named_value(tag: str, name: str, value: Column) -> Column:
    return _element(tag, F.concat(_element("valueName", F.lit(name)), _element("value", value)))


LEVELS = ("verde", "amarillo", " Naranja ", "rojo")


def warning_documents(spark, d):
    """One CAP message per document; a poll is a bulletin of a hundred messages."""
    k = F.col("key")
    n = F.floor(k / 3)
    odd = n % 50
    level = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (n % 4 + 1).cast("int"))
    x, y = _lon(k), _lat(k)

    def outline(*corners):
        pairs = [F.concat(_degrees(y + b), F.lit(","), _degrees(x + a)) for a, b in (*corners, corners[0])]
        return F.concat_ws(" ", *pairs)

    # squares, every seventh twisted into two unequal lobes, every eleventh without an area
    polygon = (
        F.when(k % 7 == 0, outline((0, 0), (100, 0), (20, 100), (80, 100)))
        .when(k % 11 == 0, outline((0, 0), (100, 0), (50, 0)))
        .otherwise(outline((0, 0), (100, 0), (100, 100), (0, 100)))
    )

    def moment(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

    def info(language, event):
        return _element(
            "info",
            F.concat(
                _element("language", F.lit(language)),
                _element("event", F.lit(event)),
                _element("severity", F.lit("Severe")),
                _named_value("eventCode", feeds.NAME_PHENOMENON, F.lit("VI;Viento")),
                F.when(odd != 6, _element("onset", F.concat(moment("at"), F.lit("+02:00")))).otherwise(""),
                _element(
                    "expires",
                    F.when(odd == 5, F.lit("soon")).otherwise(
                        F.concat(moment(F.col("at") + F.make_dt_interval(hours=k % 48 + 1)), F.lit("-00:00"))
                    ),
                ),
                _element("headline", F.lit(event)),
                _named_value("parameter", feeds.NAME_LEVEL, F.lit("")),
                F.when(odd != 7, _named_value("parameter", feeds.NAME_LEVEL, level)).otherwise(""),
                _named_value("parameter", feeds.NAME_PROBABILITY, F.lit("40%-70%")),
                _element(
                    "area",
                    F.concat(
                        _element("areaDesc", F.concat(F.lit("Zona "), (n % 9).cast("string"))),
                        F.when(odd != 8, _element("polygon", polygon)).otherwise(""),
                        _named_value("geocode", feeds.NAME_ZONE, F.lpad((n % 9).cast("string"), 6, "7")),
                    ),
                ),
            ),
        )

    kind = F.when(odd % 10 == 9, "Cancel").when(odd % 10 == 4, "Update").otherwise("Alert")
    refs = F.concat(
        F.lit("sender,cap-"), (k - 3).cast("string"), F.lit(",2020-01-01T00:00:00-00:00 broken,ref "),
        F.lit("sender,cap-"), (k - 6).cast("string"), F.lit(",2020-01-01T00:00:00-00:00"),
    )
    body = F.concat(
        F.when(odd != 1, _element("identifier", F.concat(F.lit("cap-"), k.cast("string")))).otherwise(""),
        _element("sent", F.concat(moment("at"), F.lit("-00:00"))),
        _element("msgType", kind),
        F.when(kind != "Alert", _element("references", refs)).otherwise(""),
        F.when(kind != "Cancel", F.concat(info("en-GB", "Wind warning"), info("es-ES", "Aviso de viento")))
        .otherwise(""),
    )
    payload = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">'),
        body,
        F.when(odd == 2, F.lit("")).otherwise("</alert>"),
    )
    return _orders(spark, d).select(
        F.floor(k / 300).cast("string").alias("poll_id"),
        F.concat(F.lit("cap-"), F.lpad(k.cast("string"), 12, "0")).alias("doc_id"),
        payload.alias("payload"),
    )


def ingest_warnings(spark, d):
    """All readable messages, cancellations included."""
    good, _, _ = feeds.split_malformed(feeds.ingest_warnings(warning_documents(spark, d)))
    return good.select(
        "poll_id", "external_id", "msg_type", "sent", F.array_join("references", " ").alias("refs"),
        "event", "phenomenon", "level", "onset", "expires", "zone", "area_desc",
        F.col("extra.probability").alias("probability"),
    )


WARNINGS = f"""{ORD}, w AS (SELECT *, key // 3 AS n, (key // 3) % 50 AS odd FROM o),
m AS (SELECT *, CASE WHEN odd % 10 = 9 THEN 'Cancel' WHEN odd % 10 = 4 THEN 'Update'
                     ELSE 'Alert' END AS msg_type FROM w),
r AS (SELECT CAST(key // 300 AS VARCHAR) AS poll_id, 'cap-' || key AS external_id, msg_type,
  t0 AS sent, CASE WHEN msg_type <> 'Alert' THEN 'cap-' || (key - 3) || ' cap-' || (key - 6)
                   ELSE '' END AS refs, msg_type <> 'Cancel' AS has_info, key, n, odd, t0, lon_m, lat_m
  FROM m WHERE odd NOT IN (1, 2, 5)),
f AS (SELECT poll_id, external_id, msg_type, sent, refs, odd,
  CASE WHEN has_info THEN 'Aviso de viento' END AS event,
  CASE WHEN has_info THEN 'VI;Viento' END AS phenomenon,
  CASE WHEN has_info AND odd <> 7 THEN ['verde', 'amarillo', ' Naranja ', 'rojo'][n % 4 + 1] END AS level,
  CASE WHEN has_info AND odd <> 6 THEN t0 - INTERVAL 2 HOUR END AS onset,
  CASE WHEN has_info THEN t0 + to_hours(CAST(key % 48 + 1 AS INTEGER)) END AS expires,
  CASE WHEN has_info THEN lpad(CAST(n % 9 AS VARCHAR), 6, '7') END AS zone,
  CASE WHEN has_info THEN 'Zona ' || (n % 9) END AS area_desc,
  CASE WHEN has_info THEN '40%-70%' END AS probability, key, lon_m, lat_m FROM r)"""


def ingestible_warnings(spark, d):
    good, _, _ = feeds.split_malformed(feeds.ingest_warnings(warning_documents(spark, d)))
    return fit_warnings(good).select("external_id", "msg_type", "level")


def warning_events(spark, d):
    """Event rows of the ingestible warnings, with the middle of their areas in thousandths of a milli-degree."""
    good, _, _ = feeds.split_malformed(feeds.ingest_warnings(warning_documents(spark, d)))
    rows, _ = feeds.warning_events(good)
    placed = grid.computed(rows, c=geometry.centroid(F.col("geom")))
    return placed.select(
        "external_id", "severity", "starts_at", "ends_at", "attrs", F.size("geom.parts").alias("lobes"),
        F.round(F.col("c.x") * 1000, 3).alias("mid_x"), F.round(F.col("c.y") * 1000, 3).alias("mid_y"),
    )


def warnings_aside(spark, d):
    """Ingestible warnings put aside because their area encloses nothing."""
    good, _, _ = feeds.split_malformed(feeds.ingest_warnings(warning_documents(spark, d)))
    return feeds.warning_events(good)[1].select("external_id", "level")


FIT = "level IS NOT NULL AND level <> 'verde' AND onset IS NOT NULL AND odd <> 8 AND msg_type <> 'Cancel'"
FLAT = "(key % 7 <> 0 AND key % 11 = 0)"
WARNING_EVENTS_SQL = f"""WITH {WARNINGS}
SELECT external_id, CAST(CASE level WHEN 'amarillo' THEN 2 WHEN ' Naranja ' THEN 3 ELSE 4 END AS SMALLINT)
    AS severity, onset AS starts_at, expires AS ends_at,
  '{{"event":"Aviso de viento","phenomenon":"VI;Viento","level":"' || level || '","zone":"' || zone
  || '","area_desc":"' || area_desc
  || '","headline":"Aviso de viento","cap_severity":"Severe","probability":"40%-70%"}}' AS attrs,
  CAST(CASE WHEN key % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS lobes, CAST(lon_m + 50 AS DOUBLE) AS mid_x,
  round(lat_m + CASE WHEN key % 7 = 0 THEN (3125 * 62.5 / 3 + 1125 * 87.5) / 4250 ELSE 50 END, 3)::DOUBLE AS mid_y
FROM f WHERE {FIT} AND NOT {FLAT}"""


GUARD_DOCUMENTS, GUARD_BYTES = 600, 980


def bulletin_guard(spark, d):
    """Line items as documents of a supplier's bulletin, judged by tighter limits."""
    li = table(spark, d, "lineitem")
    documents = li.select(
        F.col("l_suppkey").cast("string").alias("poll_id"),
        F.repeat(F.lit("é"), (F.col("l_quantity") * 10).cast("int") - (F.col("l_suppkey") % 40).cast("int"))
        .alias("payload"),
    )
    kept, refused = feeds.bulletin_guard(documents, GUARD_DOCUMENTS, GUARD_BYTES)
    kept_counts = kept.groupBy("poll_id").agg(F.count("*").alias("documents"))
    return kept_counts.select("poll_id", "documents", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("poll_id", "documents", "reason")
    )


GUARD_SQL = f"""WITH s AS (SELECT l_suppkey, count(*) AS documents,
  max(2 * (CAST(l_quantity * 10 AS INTEGER) - l_suppkey % 40)) AS largest FROM lineitem GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS poll_id, documents,
  CASE WHEN documents > {GUARD_DOCUMENTS} THEN 'too many documents'
       WHEN largest > {GUARD_BYTES} THEN 'document too large' END AS reason FROM s"""


def coords_ok(spark, d):
    """Vertex checks on text coordinates, good and bad."""
    k = F.col("o_orderkey")
    odd = k % 9
    x = (
        F.when(odd == 1, "nan").when(odd == 2, "1e999").when(odd == 3, "-180.5").when(odd == 4, "x")
        .otherwise(_degrees(_lon(k)))
    )
    y = F.when(odd == 5, "90.001").when(odd == 6, "90").otherwise(_degrees(_lat(k)))
    ring = F.when(odd == 7, F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.array(
            geometry.vertex(F.lit(0.0), F.lit(0.0)),
            geometry.vertex(x.try_cast("double"), y.try_cast("double")),
        )
    )
    return table(spark, d, "orders").select("o_orderkey", geometry.coordinates_ok(ring).alias("ok"))


def content_hash(spark, d):
    """Digest per poll row; a re-served record keeps it."""
    digest = values.content_hash(
        k=F.col("k"), external_id=F.col("external_id"),
        kind=F.when(F.col("k") % 2 == 0, F.col("event_type")),
    )
    return polls(spark, d).select("ordinal", digest.alias("content_hash"))


HASH_SQL = f"""WITH {POLLS_SQL} SELECT ordinal, sha256('{{"external_id":"' || external_id || '","k":' || k
  || CASE WHEN k % 2 = 0 THEN ',"kind":"' || event_type || '"' ELSE '' END || '}}') AS content_hash
FROM polls"""

QUERIES = {
    "ingest_quakes": ingest_quakes,
    "split_malformed": split_malformed,
    "ingest_hotspots": ingest_hotspots,
    "ingest_burnt_areas": ingest_burnt_areas,
    "ingest_warnings": ingest_warnings,
    "ingestible_warnings": ingestible_warnings,
    "warning_events": warning_events,
    "warnings_aside": warnings_aside,
    "bulletin_guard": bulletin_guard,
    "coords_ok": coords_ok,
    "content_hash": content_hash,
}

ORACLES = {
    "ingest_quakes": QUAKES_SQL,
    "split_malformed": GATE_SQL,
    "ingest_hotspots": HOTSPOTS_SQL,
    "ingest_burnt_areas": AREAS_SQL,
    "ingest_warnings": f"WITH {WARNINGS} SELECT * EXCLUDE (odd, key, lon_m, lat_m) FROM f",
    "ingestible_warnings": f"WITH {WARNINGS} SELECT external_id, msg_type, level FROM f WHERE {FIT}",
    "warning_events": WARNING_EVENTS_SQL,
    "warnings_aside": f"WITH {WARNINGS} SELECT external_id, level FROM f WHERE {FIT} AND {FLAT}",
    "bulletin_guard": GUARD_SQL,
    "coords_ok": "SELECT o_orderkey, o_orderkey % 9 IN (0, 6, 8) AS ok FROM orders",
    "content_hash": HASH_SQL,
}
