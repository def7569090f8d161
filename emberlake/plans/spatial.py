"""Spatial queries: projection, point-in-area join, radius search, clusters, ring audit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from emberlake.functions import geometry, projection
from emberlake.operators import checks, clusters, filters, grid, near as radius, rings, spatial_join
from emberlake.operators.export import cluster_feature_rows, to_feature_rows
from emberlake.plans.carriers import (
    PROVINCES_SQL,
    WITHIN_SQL,
    derive_long_rings,
    derive_rings,
    hazards,
    hazards_sql,
    national_areas,
    LONG_RINGS_SQL,
    RINGS_SQL,
    table,
)
from emberlake.sources.provinces import prepare_provinces

HZ = hazards_sql()
HZ_CLUMPED = hazards_sql(clumped=True)
CENTRE = (-3.70, 40.42)
RADIUS_M, NEAREST = 150_000, 500
JOIN_RADIUS_M, JOIN_NEAREST = 12_000, 20
EPS_M, MIN_POINTS = 700, 4
SINCE = dt.datetime(1995, 1, 1, tzinfo=dt.timezone.utc)


def _num(value: float) -> str:
    return format(value, ".17e")


def metric_sql(source: str, keep: str) -> str:
    """Subquery that adds metres (x, y) to a relation with degrees (lon, lat)."""
    scale, e = _num(projection.SCALE * projection.RADIUS), _num(projection.ECCENTRICITY)
    east = " + ".join(
        f"{_num(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        for j, a in enumerate(projection.ALPHA, start=1)
    )
    north = " + ".join(
        f"{_num(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)"
        for j, a in enumerate(projection.ALPHA, start=1)
    )
    return f"""(SELECT {keep}, 500000 + {scale} * (eta + {east}) AS x, {scale} * (xi + {north}) AS y
  FROM (SELECT {keep}, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta
  FROM (SELECT {keep}, sinh(atanh(s) - {e} * atanh({e} * s)) AS t, dl
  FROM (SELECT {keep}, sin(radians(lat)) AS s, radians(lon + 3) AS dl FROM {source}))))"""


def degrees_sql(source: str, keep: str) -> str:
    """Subquery that turns metres (x, y) of a relation into degrees (lon, lat)."""
    scale = _num(projection.SCALE * projection.RADIUS)
    xi = " - ".join(
        f"{_num(b)} * sin({2 * j} * xi0) * cosh({2 * j} * eta0)"
        for j, b in enumerate(projection.BETA, start=1)
    )
    eta = " - ".join(
        f"{_num(b)} * cos({2 * j} * xi0) * sinh({2 * j} * eta0)"
        for j, b in enumerate(projection.BETA, start=1)
    )
    lat = " + ".join(
        f"{_num(d)} * sin({2 * j} * chi)" for j, d in enumerate(projection.DELTA, start=1)
    )
    return f"""(SELECT {keep}, -3 + degrees(atan2(sinh(eta), cos(xi))) AS lon,
  degrees(chi + {lat}) AS lat
  FROM (SELECT *, asin(sin(xi) / cosh(eta)) AS chi
  FROM (SELECT *, xi0 - {xi} AS xi, eta0 - {eta} AS eta
  FROM (SELECT *, y / {scale} AS xi0, (x - 500000) / {scale} AS eta0 FROM {source}))))"""


# Shape corners of `hz`: `part` and `i` (0..4, closed), in milli-degrees.
CORNERS_SQL = """
corners AS (
  SELECT id, part, i,
    CASE WHEN source = 'aemet' THEN zx + [-500, 300, 500, -300][i % 4 + 1]
         ELSE lon_m + 4 * h * part + h * [-1, 1, 1, -1][i % 4 + 1] END / 1000.0::DOUBLE AS lon,
    CASE WHEN source = 'aemet' THEN zy + [-400, -400, 400, 400][i % 4 + 1]
         ELSE lat_m + h * [-1, -1, 1, 1][i % 4 + 1] END / 1000.0::DOUBLE AS lat
  FROM hz, (SELECT unnest(range(2)) AS part), (SELECT unnest(range(5)) AS i)
  WHERE (source = 'aemet' OR kind = 'burnt_area')
    AND (part = 0 OR (source = 'effis' AND key % 12 = 9)))"""

POINTS_SQL = """
spots AS (SELECT id, lon_m / 1000.0::DOUBLE AS lon, lat_m / 1000.0::DOUBLE AS lat FROM hz
          WHERE source = 'ign' OR kind = 'hotspot')"""


def _segments_sql() -> str:
    return f"""{CORNERS_SQL},
mc AS (SELECT * FROM {metric_sql('corners', 'id, part, i')}),
segs AS (SELECT a.id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM mc a
         JOIN mc b ON a.id = b.id AND a.part = b.part AND b.i = a.i + 1)"""


def _shape_distance_sql(px: str, py: str, by: str) -> str:
    """Distance of (px, py) to the segments of each group: 0 inside."""
    return f"""CASE WHEN count(*) FILTER ((y1 > {py}) <> (y2 > {py})
    AND {px} < x1 + (x2 - x1) * ({py} - y1) / (y2 - y1)) % 2 = 1 THEN 0.0
  ELSE sqrt(min(
    pow({px} - x1 - t * (x2 - x1), 2) + pow({py} - y1 - t * (y2 - y1), 2))) END"""


def _along_sql(px: str, py: str) -> str:
    return f"""greatest(0, least(1, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1))
    / (pow(x2 - x1, 2) + pow(y2 - y1, 2))))"""


def project(spark, d):
    """Metres of the first vertex of every event, and the way back."""
    h = hazards(spark, d)
    first = F.col("geom")["parts"][0][0][0]
    m = grid.computed(h.select("id", "geom"), m=projection.to_metres(first["x"], first["y"]))
    back = grid.computed(m, g=projection.to_degrees(F.col("m.x"), F.col("m.y")))
    return back.select(
        "id",
        F.round("m.x", 1).alias("x"),
        F.round("m.y", 1).alias("y"),
        F.round(F.col("g.x") * 1000).cast("bigint").alias("lon_m"),
        F.round(F.col("g.y") * 1000).cast("bigint").alias("lat_m"),
    )


PROJECT_SQL = f"""WITH {HZ}, {POINTS_SQL}, {CORNERS_SQL},
firsts AS (SELECT id, lon, lat FROM spots UNION ALL SELECT id, lon, lat FROM corners WHERE part = 0 AND i = 0),
m AS (SELECT id, lon, lat, round(x, 1) AS x, round(y, 1) AS y FROM {metric_sql('firsts', 'id, lon, lat')})
SELECT id, x, y, CAST(round(lon * 1000) AS BIGINT) AS lon_m, CAST(round(lat * 1000) AS BIGINT) AS lat_m FROM m"""


def join_within(spark, d):
    """Every event, points and areas alike, placed in the province of its centroid."""
    provinces = prepare_provinces(national_areas(spark, d))
    return spatial_join.join_within(hazards(spark, d), provinces, keep=["hazard_type"])


JOIN_SQL = f"""WITH {HZ}, {PROVINCES_SQL},
c AS (SELECT id, hazard_type,
        CASE WHEN source = 'aemet' THEN zx
             ELSE lon_m + CASE WHEN source = 'effis' AND key % 12 = 9 THEN 2 * h ELSE 0 END END AS px,
        CASE WHEN source = 'aemet' THEN zy ELSE lat_m END AS py FROM hz)
SELECT id, hazard_type, province_code, name FROM c JOIN pv ON {WITHIN_SQL}"""


def near(spark, d):
    lon, lat = CENTRE
    hits = radius.near(
        hazards(spark, d), lon=lon, lat=lat, radius_m=RADIUS_M, limit=NEAREST, severity_min=2
    )
    return hits.select("id", "hazard_type", F.round("distance_m", 1).alias("distance_m"))


NEAR_SQL = f"""WITH {HZ}, {POINTS_SQL}, {_segments_sql()},
c AS (SELECT x AS px, y AS py FROM {metric_sql(
    f"(SELECT {CENTRE[0]}::DOUBLE AS lon, {CENTRE[1]}::DOUBLE AS lat)", "lon")}),
dist AS (
  SELECT id, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS dm FROM {metric_sql('spots', 'id')}, c
  UNION ALL
  SELECT id, {_shape_distance_sql('px', 'py', 'id')} AS dm
  FROM (SELECT *, {_along_sql('px', 'py')} AS t FROM segs, c) GROUP BY id, px, py)
SELECT id, hazard_type, round(dm, 1) AS distance_m FROM dist JOIN hz USING (id)
WHERE dm <= {RADIUS_M} AND severity >= 2 ORDER BY dm, id LIMIT {NEAREST}"""


def near_join(spark, d):
    """Nearest events around every supplier's position."""
    s = F.col("s_suppkey")
    centres = table(spark, d, "supplier").select(
        s.alias("centre_id"),
        ((-9300 + (s * 6007) % 12500).cast("double") / F.lit(1000.0)).alias("lon"),
        ((36200 + (s * 70001) % 7400).cast("double") / F.lit(1000.0)).alias("lat"),
    )
    out = radius.near_join(
        hazards(spark, d), centres, radius_m=JOIN_RADIUS_M, limit=JOIN_NEAREST
    )
    return out.select("centre_id", "id", "rank", F.round("distance_m", 1).alias("distance_m"))


NEAR_JOIN_SQL = f"""WITH {HZ}, {POINTS_SQL}, {_segments_sql()},
ctr AS (SELECT s_suppkey AS centre_id, (-9300 + (s_suppkey * 6007) % 12500) / 1000.0::DOUBLE AS lon,
               (36200 + (s_suppkey * 70001) % 7400) / 1000.0::DOUBLE AS lat FROM supplier),
c AS (SELECT centre_id, x AS px, y AS py FROM {metric_sql('ctr', 'centre_id')}),
bounds AS (SELECT id, min(x1) AS wx, max(x1) AS ex, min(y1) AS sy, max(y1) AS ny FROM segs GROUP BY 1),
cand AS (SELECT id, centre_id, px, py FROM bounds JOIN c
  ON px BETWEEN wx - {JOIN_RADIUS_M} AND ex + {JOIN_RADIUS_M}
  AND py BETWEEN sy - {JOIN_RADIUS_M} AND ny + {JOIN_RADIUS_M}),
dist AS (
  SELECT id, centre_id, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS dm
  FROM {metric_sql('spots', 'id')} m JOIN c ON m.x BETWEEN px - {JOIN_RADIUS_M} AND px + {JOIN_RADIUS_M}
    AND m.y BETWEEN py - {JOIN_RADIUS_M} AND py + {JOIN_RADIUS_M}
  UNION ALL
  SELECT id, centre_id, {_shape_distance_sql('px', 'py', 'id')} AS dm
  FROM (SELECT *, {_along_sql('px', 'py')} AS t FROM segs JOIN cand USING (id))
  GROUP BY id, centre_id, px, py),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY centre_id ORDER BY dm, id) AS INTEGER) AS rank
      FROM dist WHERE dm <= {JOIN_RADIUS_M})
SELECT centre_id, id, rank, round(dm, 1) AS distance_m FROM r WHERE rank <= {JOIN_NEAREST}"""


def dbscan_labels(spark, d):
    """Clusters of all events of the clumped table, points and areas."""
    return clusters.dbscan_labels(
        hazards(spark, d, clumped=True), eps_m=EPS_M, min_points=MIN_POINTS, starts_after=SINCE
    )


def cluster_summary(spark, d):
    """Summaries of the clusters of the whole clumped table, early and undated events included."""
    with checks.overridden(unbounded_clusters=True):
        out = clusters.cluster_summary(hazards(spark, d, clumped=True), eps_m=EPS_M, min_points=MIN_POINTS)
    return out.withColumn("lon", F.round("lon", 5)).withColumn("lat", F.round("lat", 5))


def cluster_features(spark, d):
    """Summaries of all clumped events as GeoJSON features, read back for comparison of their members."""
    f = F.col("feature")

    def member(path, kind, name):
        return F.get_json_object(f, path).cast(kind).alias(name)

    return cluster_feature_rows(cluster_summary(spark, d)).select(
        "cluster_id",
        member("$.type", "string", "type"),
        member("$.geometry.type", "string", "kind"),
        member("$.geometry.coordinates[0]", "double", "lon"),
        member("$.geometry.coordinates[1]", "double", "lat"),
        member("$.properties.cluster_id", "int", "own_id"),
        member("$.properties.count", "bigint", "count"),
        member("$.properties.max_severity", "smallint", "max_severity"),
        member("$.properties.first_starts_at", "string", "first_starts_at"),
        member("$.properties.last_starts_at", "string", "last_starts_at"),
    )


def near_features(spark, d):
    """The events of a radius query as GeoJSON features, read back for comparison of their members."""
    lon, lat = CENTRE
    hits = radius.near(hazards(spark, d), lon=lon, lat=lat, radius_m=RADIUS_M, limit=NEAREST, severity_min=2)
    f = F.col("feature")
    return to_feature_rows(hits).select(
        "id",
        F.get_json_object(f, "$.id").alias("feature_id"),
        F.get_json_object(f, "$.geometry.type").alias("kind"),
        F.get_json_object(f, "$.properties.hazard_type").alias("hazard_type"),
        F.get_json_object(f, "$.properties.distance_m").cast("double").alias("distance_m"),
    )


# Equal geometries are one site with the smallest id and their number. Distances between sites go by bounding boxes and
# grid cells first; labels spread along core links until none changes.
CLUSTERS_SQL = f"""WITH RECURSIVE {HZ_CLUMPED}, {POINTS_SQL}, {_segments_sql()},
place AS (SELECT id, min(id) OVER (PARTITION BY lon, lat) AS site FROM spots
  UNION ALL SELECT id, min(id) OVER (PARTITION BY source, CASE WHEN source = 'aemet' THEN zone END,
    CASE WHEN source <> 'aemet' THEN (lon_m, lat_m, h, key % 12 = 9) END) AS site
  FROM hz WHERE source = 'aemet' OR kind = 'burnt_area'),
weight AS (SELECT site, count(*) AS w FROM place GROUP BY 1),
m AS (SELECT id AS site, x, y, CAST(floor(x / {EPS_M}) AS BIGINT) AS cx, CAST(floor(y / {EPS_M}) AS BIGINT) AS cy
      FROM {metric_sql('(SELECT * FROM spots WHERE id IN (SELECT site FROM weight))', 'id')}),
around AS (SELECT site, x, y, cx + i AS cx, cy + j AS cy FROM m,
  (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
sides AS (SELECT id AS site, x1, y1, x2, y2 FROM segs WHERE id IN (SELECT site FROM weight)),
bounds AS (SELECT site, min(x1) AS wx, max(x1) AS ex, min(y1) AS sy, max(y1) AS ny FROM sides GROUP BY 1),
asked AS (
  SELECT b.site AS s, m.site AS o, x AS px, y AS py FROM bounds b
  JOIN m ON x BETWEEN wx - {EPS_M} AND ex + {EPS_M} AND y BETWEEN sy - {EPS_M} AND ny + {EPS_M}
  UNION ALL
  SELECT DISTINCT b.site AS s, c.site AS o, k.x1 AS px, k.y1 AS py FROM bounds b
  JOIN bounds c ON b.site <> c.site AND b.wx <= c.ex + {EPS_M} AND c.wx <= b.ex + {EPS_M}
    AND b.sy <= c.ny + {EPS_M} AND c.sy <= b.ny + {EPS_M}
  JOIN sides k ON k.site = c.site),
dist AS (SELECT s, o, {_shape_distance_sql('px', 'py', 's, o')} AS dm
  FROM (SELECT s, o, px, py, x1, y1, x2, y2, {_along_sql('px', 'py')} AS t FROM asked JOIN sides ON sides.site = s)
  GROUP BY s, o, px, py),
nb AS (
  SELECT a.site AS a, b.site AS b FROM around a JOIN m b USING (cx, cy)
  WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= {EPS_M}
  UNION SELECT s, o FROM dist WHERE dm <= {EPS_M} UNION SELECT o, s FROM dist WHERE dm <= {EPS_M}
  UNION SELECT site, site FROM bounds),
core AS (SELECT a AS site FROM nb JOIN weight ON b = site GROUP BY 1 HAVING sum(w) >= {MIN_POINTS}),
ce AS (SELECT a, b FROM nb WHERE a IN (FROM core) AND b IN (FROM core) AND a <> b),
lab(site, cluster) USING KEY (site) AS (
  SELECT site, site AS cluster FROM core
  UNION
  SELECT now.site, min(lab.cluster) FROM lab JOIN ce ON lab.site = ce.a JOIN recurring.lab AS now ON now.site = ce.b
  WHERE lab.cluster < now.cluster GROUP BY 1),
homes AS (SELECT site, cluster FROM lab
  UNION ALL SELECT nb.a AS site, min(lab.cluster) AS cluster FROM nb JOIN lab ON nb.b = lab.site
  WHERE nb.a NOT IN (FROM core) GROUP BY 1),
members AS (SELECT id, cluster FROM place JOIN homes USING (site))"""

# Area and first moments of a part about its first corner.
MOMENTS_SQL = """
turns AS (SELECT a.id AS site, a.part, o.x AS ox, o.y AS oy, a.x - o.x AS x1, a.y - o.y AS y1, b.x - o.x AS x2, b.y - o.y AS y2
  FROM mc a JOIN mc b ON a.id = b.id AND a.part = b.part AND b.i = a.i + 1
  JOIN mc o ON a.id = o.id AND a.part = o.part AND o.i = 0 WHERE a.id IN (SELECT site FROM weight)),
parts AS (SELECT site, ox, oy, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 3 AS mx,
  sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 3 AS my FROM turns GROUP BY site, part, ox, oy),
areas AS (SELECT site, sum(abs(a)) AS a, sum(abs(a) * ox + sign(a) * mx) AS mx, sum(abs(a) * oy + sign(a) * my) AS my
  FROM parts GROUP BY 1)"""

SUMMARY_SQL = f"""{CLUSTERS_SQL}, {MOMENTS_SQL},
whole AS (SELECT cluster, count(*) AS count, max(severity) AS max_severity,
        min(starts_at) AS first_starts_at, max(starts_at) AS last_starts_at
  FROM members JOIN hz USING (id) GROUP BY 1),
centre AS (SELECT cluster,
    CASE WHEN sum(w * a) > 0 THEN sum(w * mx) / sum(w * a) ELSE sum(w * x) / sum(w) END AS x,
    CASE WHEN sum(w * a) > 0 THEN sum(w * my) / sum(w * a) ELSE sum(w * y) / sum(w) END AS y
  FROM homes JOIN weight USING (site) LEFT JOIN m USING (site) LEFT JOIN areas USING (site) GROUP BY 1),
top AS (SELECT *, CAST(row_number() OVER (ORDER BY count DESC, cluster) - 1 AS INTEGER) AS cluster_id
        FROM whole JOIN centre USING (cluster)),
summary AS (SELECT cluster_id, cluster, count, max_severity, first_starts_at, last_starts_at,
  round(lon, 5) AS lon, round(lat, 5) AS lat
FROM {degrees_sql('top', 'cluster_id, cluster, count, max_severity, first_starts_at, last_starts_at')})"""

CLUSTER_FEATURES_SQL = SUMMARY_SQL + """
SELECT cluster_id, 'Feature' AS type, 'Point' AS kind, lon, lat, cluster_id AS own_id, count, max_severity,
  strftime(first_starts_at, '%Y-%m-%dT%H:%M:%SZ') AS first_starts_at,
  strftime(last_starts_at, '%Y-%m-%dT%H:%M:%SZ') AS last_starts_at
FROM summary"""

NEAR_FEATURES_SQL = f"""SELECT id, id AS feature_id,
  CASE WHEN hazard_type = 'weather_warning' THEN 'Polygon' WHEN hazard_type = 'earthquake' OR kind = 'hotspot' THEN 'Point'
       WHEN key % 12 = 9 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, hazard_type, distance_m
FROM ({NEAR_SQL.replace('SELECT id, hazard_type, round(dm, 1)', 'SELECT id, hazard_type, kind, key, round(dm, 1)')})"""


def audit_rings(spark, d):
    """Crossings, area and centre of four-cornered rings, some of which are twisted or flat."""
    # The shift keeps exact halves of the last digit from rounding either way.
    shift = F.lit(1.3e-7)
    return rings.audit_rings(derive_rings(spark, d)).select(
        "key", "crossings", "crossing", F.round(F.col("area") + shift, 6).alias("area"), "empty",
        F.round(F.col("x") + shift, 6).alias("x"), F.round(F.col("y") + shift, 6).alias("y"),
    )


def audit_long_rings(spark, d):
    """The same of rings too long to be judged pair by pair."""
    found = rings.audit_rings(derive_long_rings(spark, d))
    return found.select(
        "key", "crossings", "crossing", F.round("area", 6).alias("area"), "empty",
        F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
    )


QUERIES = {
    "project": project,
    "join_within": join_within,
    "near": near,
    "near_join": near_join,
    "dbscan_labels": dbscan_labels,
    "cluster_summary": cluster_summary,
    "cluster_features": cluster_features,
    "near_features": near_features,
    "audit_rings": audit_rings,
    "audit_long_rings": audit_long_rings,
}

ORACLES = {
    "project": PROJECT_SQL,
    "join_within": JOIN_SQL,
    "near": NEAR_SQL,
    "near_join": NEAR_JOIN_SQL,
    "dbscan_labels": f"{CLUSTERS_SQL} SELECT id, cluster FROM members",
    "cluster_summary": f"{SUMMARY_SQL} SELECT * FROM summary",
    "cluster_features": CLUSTER_FEATURES_SQL,
    "near_features": NEAR_FEATURES_SQL,
    "audit_rings": RINGS_SQL,
    "audit_long_rings": LONG_RINGS_SQL,
}
