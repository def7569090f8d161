"""Export projections: snapshot rows and GeoJSON features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.functions import geometry


def export_rows(events: DataFrame, source: str) -> DataFrame:
    """Snapshot columns of one source. The order by start is laid down by the sink."""
    return events.where(F.col("source") == source).select(*schemas.SNAPSHOT.fieldNames())


def _moment(name: str):
    return F.date_format(F.col(name), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _feature(geometry_json, identity, properties) -> Column:
    """One Feature as JSON text. The parts already are JSON and are spliced, not re-encoded."""
    head = F.concat(F.lit('{"type":"Feature",'), identity) if identity is not None else F.lit(
        '{"type":"Feature",'
    )
    return F.concat(
        head, F.lit('"geometry":'), geometry_json, F.lit(',"properties":'), properties, F.lit("}")
    )


def _object(*members) -> Column:
    """JSON object text of (name, JSON text) members; NULL becomes null."""
    parts = []
    for i, (name, value) in enumerate(members):
        parts += [F.lit(f'{"," if i else ""}"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def _text(column) -> Column:
    """JSON string literal of a column: the rendering of a one-element array, unwrapped."""
    wrapped = F.to_json(F.array(column))
    return F.when(column.isNotNull(), F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))


def _event_members():
    return [
        ("source", _text(F.col("source"))),
        ("hazard_type", _text(F.col("hazard_type"))),
        ("external_id", _text(F.col("external_id"))),
        ("severity", F.col("severity").cast("string")),
        ("starts_at", _text(_moment("starts_at"))),
        ("ends_at", _text(_moment("ends_at"))),
        ("attrs", F.col("attrs")),
    ]


def to_feature_rows(rows: DataFrame) -> DataFrame:
    """(id, feature): one GeoJSON Feature per event, attrs nested as they are.

    Rows of a radius query keep their distance, rounded to a decimetre for output only.
    """
    members = _event_members()
    if "distance_m" in rows.columns:
        members.append(("distance_m", F.round("distance_m", 1).cast("string")))
    identity = F.concat(F.lit('"id":'), _text(F.col("id")), F.lit(","))
    return rows.select(
        "id",
        _feature(geometry.to_geojson(F.col("geom")), identity, _object(*members)).alias("feature"),
    )


def cluster_feature_rows(clusters: DataFrame) -> DataFrame:
    """(cluster_id, feature): a Point feature per cluster summary row."""
    place = geometry.to_geojson(geometry.point(F.col("lon"), F.col("lat")))
    members = [
        ("cluster_id", F.col("cluster_id").cast("string")),
        ("count", F.col("count").cast("string")),
        ("max_severity", F.col("max_severity").cast("string")),
        ("first_starts_at", _text(_moment("first_starts_at"))),
        ("last_starts_at", _text(_moment("last_starts_at"))),
    ]
    return clusters.select("cluster_id", _feature(place, None, _object(*members)).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Features as JSON lines, one file per task."""
    features.select("feature").write.mode("overwrite").text(path)
