"""Fixed schemas. Nothing is inferred: an all-NULL column must not change a table's type."""

from __future__ import annotations

from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(VERTEX)
PARTS = T.ArrayType(T.ArrayType(RING))

GEOMETRY = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("parts", PARTS),
        T.StructField("minx", T.DoubleType()),
        T.StructField("miny", T.DoubleType()),
        T.StructField("maxx", T.DoubleType()),
        T.StructField("maxy", T.DoubleType()),
    ]
)

SNAPSHOT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("hazard_type", T.StringType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("severity", T.ShortType()),
        T.StructField("starts_at", T.TimestampType()),
        T.StructField("ends_at", T.TimestampType()),
        T.StructField("geom", GEOMETRY),
        T.StructField("attrs", T.StringType()),
    ]
)

EVENTS = T.StructType(
    [
        *SNAPSHOT.fields,
        T.StructField("content_hash", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

PROVINCES = T.StructType(
    [
        T.StructField("province_code", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("geom", GEOMETRY),
    ]
)

POLL_LOG = T.StructType(
    [
        T.StructField("poll_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("err", T.StringType()),
        T.StructField("cursor", T.StringType()),
    ]
)

SYNC_STATE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("last_run_at", T.TimestampType()),
        T.StructField("last_success_at", T.TimestampType()),
        T.StructField("cursor", T.StringType()),
        T.StructField("last_error", T.StringType()),
        T.StructField("consecutive_failures", T.IntegerType()),
    ]
)

CHANGE_LOG = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("inserted", T.LongType()),
        T.StructField("updated", T.LongType()),
        T.StructField("closed", T.LongType()),
    ]
)

# The closed domains of an event.
SOURCES = ("effis", "ign", "aemet")
HAZARD_TYPES = ("wildfire", "earthquake", "weather_warning")
SEVERITY_MIN, SEVERITY_MAX = 1, 4
