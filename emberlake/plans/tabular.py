"""Reports, listing filters and table checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from emberlake.functions import severity, values
from emberlake.operators import export, filters, reports
from emberlake.plans.carriers import (
    PROVINCES_SQL,
    WITHIN_SQL,
    hazards,
    hazards_root,
    hazards_sql,
    national_areas,
    table,
)
from emberlake.sources import snapshot
from emberlake.sources.provinces import prepare_provinces

HZ = hazards_sql()
YEAR = 2000
UTC = dt.timezone.utc
SPAN = (dt.datetime(1998, 3, 1, tzinfo=UTC), dt.datetime(2000, 9, 30, 12, tzinfo=UTC))
MOMENT = dt.datetime(1999, 6, 15, 6, tzinfo=UTC)
BBOX = (-5.0255, 38.0305, -1.2005, 41.5505)
PAGE_KEY = (dt.datetime(2000, 5, 17, 9, 33, tzinfo=UTC), "80000000-0000-0000-0000-000000000000")
IN_YEAR = f"starts_at >= TIMESTAMP '{YEAR}-01-01' AND starts_at < TIMESTAMP '{YEAR + 1}-01-01'"


def provinces(spark, d):
    return prepare_provinces(national_areas(spark, d))


def _of_year(spark, d, source):
    """The report's slice of the snapshot: one source, one year."""
    return hazards(spark, d, source=source, years=(YEAR, YEAR))


def burned_area_by_month(spark, d):
    return reports.burned_area_by_month(
        _of_year(spark, d, "effis"), provinces(spark, d), year=YEAR
    )


def burned_area_one_province(spark, d):
    return reports.burned_area_by_month(
        _of_year(spark, d, "effis"), provinces(spark, d), year=YEAR, province_code="42"
    )


def _burned_sql(extra: str) -> str:
    return f"""WITH {HZ}, {PROVINCES_SQL},
fires AS (SELECT *, lon_m + CASE WHEN key % 12 = 9 THEN 2 * h ELSE 0 END AS px, lat_m AS py
          FROM hz WHERE kind = 'burnt_area' AND {IN_YEAR})
SELECT province_code, name AS province, CAST(month(starts_at) AS INTEGER) AS month,
       count(*) AS events, CAST(round(sum(area_ha), 1) AS DOUBLE) AS burned_area_ha
FROM fires JOIN pv ON {WITHIN_SQL} {extra}
GROUP BY 1, 2, 3 ORDER BY 1, 3"""


def plane_parity(spark, d):
    """Operational and analytical hectares of the fires that started in the report's year."""
    events = hazards(spark, d).where(reports.in_year("starts_at", YEAR))
    report = reports.burned_area_by_month(events, provinces(spark, d), year=YEAR)
    return reports.plane_parity(events, report)


PARITY_SQL = f"""WITH {HZ}, {PROVINCES_SQL},
fires AS (SELECT *, lon_m + CASE WHEN key % 12 = 9 THEN 2 * h ELSE 0 END AS px, lat_m AS py
          FROM hz WHERE kind = 'burnt_area' AND {IN_YEAR}),
a AS (SELECT CAST(coalesce(sum(area_ha), 0) AS DOUBLE) AS operational_ha FROM fires),
b AS (SELECT CAST(coalesce(sum(area_ha), 0) AS DOUBLE) AS analytical_ha
      FROM fires JOIN pv ON {WITHIN_SQL})
SELECT operational_ha, analytical_ha, operational_ha = analytical_ha AS agree FROM a, b"""


def quake_frequency(spark, d):
    return reports.quake_frequency(_of_year(spark, d, "ign"), year=YEAR)


def quake_frequency_min(spark, d):
    return reports.quake_frequency(_of_year(spark, d, "ign"), year=YEAR, min_magnitude=4.5)


def _quake_sql(minimum: float) -> str:
    return f"""WITH {HZ}
SELECT CAST(month(starts_at) AS INTEGER) AS month, count(*) AS events,
       max(CAST(json_extract_string(attrs, '$.magnitude') AS DOUBLE)) AS max_magnitude
FROM hz WHERE hazard_type = 'earthquake' AND {IN_YEAR}
  AND CAST(json_extract_string(attrs, '$.magnitude') AS DOUBLE) >= {minimum}
GROUP BY 1 ORDER BY 1"""


def warnings_summary(spark, d):
    return reports.warnings_summary(_of_year(spark, d, "aemet"), year=YEAR)


def warnings_summary_code(spark, d):
    return reports.warnings_summary(_of_year(spark, d, "aemet"), year=YEAR, phenomenon_code="AT")


def _warnings_sql(extra: str) -> str:
    return f"""WITH {HZ}
SELECT json_extract_string(attrs, '$.phenomenon') AS phenomenon,
       json_extract_string(attrs, '$.level') AS level, count(*) AS warnings,
       count(DISTINCT json_extract_string(attrs, '$.zone')) AS zones
FROM hz WHERE hazard_type = 'weather_warning' AND {IN_YEAR} {extra}
GROUP BY 1, 2 ORDER BY 1, 2"""


def count_by_source(spark, d):
    return reports.count_by_source(hazards(spark, d))


def apply_filters(spark, d):
    kept = filters.apply_filters(
        hazards(spark, d),
        hazard_types=["wildfire", "weather_warning"],
        severity_min=3,
        starts_after=SPAN[0],
        starts_before=SPAN[1],
    )
    return kept.select("id", "source", "severity", "starts_at")


def active_events(spark, d):
    kept = filters.apply_filters(hazards(spark, d), source="effis", active_at=MOMENT)
    return kept.select("id", "starts_at", "ends_at")


def filter_bbox(spark, d):
    """Events that meet an envelope, out of the files whose boxes do."""
    return hazards(spark, d, bbox=BBOX).select("id", "hazard_type")


# The leaning zone meets the envelope when the boxes overlap and the projections on the normal of
# its leaning side (800, -200) do.
BBOX_SQL = f"""WITH {HZ},
b AS (SELECT {BBOX[0] * 1000} AS w, {BBOX[1] * 1000} AS s, {BBOX[2] * 1000} AS e,
             {BBOX[3] * 1000} AS n)
SELECT id, hazard_type FROM hz, b WHERE
  CASE WHEN source = 'ign' OR kind = 'hotspot'
       THEN lon_m BETWEEN w AND e AND lat_m BETWEEN s AND n
       WHEN kind = 'burnt_area'
       THEN lat_m - h <= n AND lat_m + h >= s
            AND ((lon_m - h <= e AND lon_m + h >= w)
                 OR (key % 12 = 9 AND lon_m + 3 * h <= e AND lon_m + 5 * h >= w))
       ELSE zx - 500 <= e AND zx + 500 >= w AND zy - 400 <= n AND zy + 400 >= s
            AND 800 * w - 200 * n <= 800 * zx - 200 * zy + 320000
            AND 800 * e - 200 * s >= 800 * zx - 200 * zy - 320000 END"""


def page_after(spark, d):
    """Listing page: active-agnostic filters, keyset order, 200 rows and one more."""
    kept = filters.apply_filters(hazards(spark, d), severity_min=2)
    return filters.page_after(kept, limit=200, after=PAGE_KEY).select("id", "source", "starts_at")


def stored_page(spark, d):
    """Pages two and three of the stored snapshot, each from the files that can hold it."""
    root = hazards_root(spark, d)
    second = snapshot.read_page(spark, root, limit=150, after=PAGE_KEY)
    key = filters.next_key(second.select("starts_at", "id").collect(), 150)
    third = snapshot.read_page(spark, root, limit=150, after=key)
    part = ["id", "source", "starts_at"]
    return second.orderBy(F.desc("starts_at"), F.desc("id")).limit(150).select(*part).unionByName(third.select(*part))


STORED_PAGE_SQL = f"""WITH {HZ}
SELECT id, source, starts_at FROM hz
WHERE starts_at < TIMESTAMP '{PAGE_KEY[0]:%Y-%m-%d %H:%M:%S}'
   OR (starts_at = TIMESTAMP '{PAGE_KEY[0]:%Y-%m-%d %H:%M:%S}' AND id < '{PAGE_KEY[1]}')
ORDER BY starts_at DESC, id DESC LIMIT 301"""


PAGE_SQL = f"""WITH {HZ}
SELECT id, source, starts_at FROM hz
WHERE severity >= 2 AND (starts_at < TIMESTAMP '{PAGE_KEY[0]:%Y-%m-%d %H:%M:%S}'
   OR (starts_at = TIMESTAMP '{PAGE_KEY[0]:%Y-%m-%d %H:%M:%S}' AND id < '{PAGE_KEY[1]}'))
ORDER BY starts_at DESC, id DESC LIMIT 201"""


def events_by_ids(spark, d):
    """Ids asked for by line items; odd line numbers ask for an id that does not exist."""
    li = table(spark, d, "lineitem")
    k = F.col("l_orderkey")
    source = F.when(k % 3 == 0, "effis").when(k % 3 == 1, "ign").otherwise("aemet")
    stem = F.when(k % 6 == 0, "hs-").when(k % 3 == 0, "ba-").when(k % 3 == 1, "es").otherwise("cap-")
    stem = F.when(F.col("l_linenumber") % 2 == 1, F.lit("x")).otherwise(stem)
    ids = li.select(
        values.event_id(source, F.concat(stem, k.cast("string"))).alias("id")
    )
    found, missing = filters.events_by_ids(hazards(spark, d), ids)
    return found.select("id", F.lit(True).alias("found")).unionByName(
        missing.select("id", F.lit(False).alias("found"))
    )


IDS_SQL = f"""WITH {HZ},
asked AS (SELECT DISTINCT
  CASE l_orderkey % 3 WHEN 0 THEN 'effis' WHEN 1 THEN 'ign' ELSE 'aemet' END AS s,
  CASE WHEN l_linenumber % 2 = 1 THEN 'x' WHEN l_orderkey % 6 = 0 THEN 'hs-'
       WHEN l_orderkey % 3 = 0 THEN 'ba-' WHEN l_orderkey % 3 = 1 THEN 'es' ELSE 'cap-' END
    || l_orderkey AS x FROM lineitem),
ids AS (SELECT regexp_replace(substr(sha256(s || '|' || x), 1, 32),
          '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM asked)
SELECT ids.id, hz.id IS NOT NULL AS found FROM ids LEFT JOIN hz ON ids.id = hz.id"""


def _with_damage(spark, d):
    """Events of which some break a domain rule."""
    k = F.col("key")
    return (
        hazards(spark, d)
        .withColumn("source", F.when(k % 101 == 5, "other").otherwise(F.col("source")))
        .withColumn("hazard_type", F.when(k % 103 != 7, F.col("hazard_type")))
        .withColumn(
            "severity", F.when(k % 107 == 9, F.lit(5)).otherwise(F.col("severity")).cast("smallint")
        )
    )


def check_domain(spark, d):
    sound, bad = filters.check_domain(_with_damage(spark, d))
    return sound.select("key", F.lit(None).cast("string").alias("problem")).unionByName(
        bad.select("key", "problem")
    )


def backfill_instants(spark, d):
    """Every end dropped first, so that the rewrite has to restore those of point events."""
    bare = hazards(spark, d).withColumn("ends_at", F.lit(None).cast("timestamp"))
    return filters.backfill_instants(bare).select("id", "source", "starts_at", "ends_at")


def severities(spark, d):
    """The three severity scales over order totals, line quantities aside."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    area = F.when(k % 11 != 0, F.floor(F.col("o_totalprice") / 50).cast("double"))
    level = F.element_at(
        F.array(*[F.lit(n) for n in ("verde", " Amarillo", "NARANJA ", "rojo")]),
        (k % 4 + 1).cast("int"),
    )
    return o.select(
        "o_orderkey",
        severity.wildfire_severity(F.lit("burnt_area"), area).alias("fire"),
        severity.wildfire_severity(F.lit("hotspot"), area).alias("hotspot"),
        severity.quake_severity((k % 71).cast("double") / F.lit(10.0)).alias("quake"),
        severity.warning_severity(level).alias("warning"),
    )


SEVERITIES_SQL = """SELECT o_orderkey,
  CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 WHEN floor(o_totalprice / 50) >= 5000 THEN 4
       WHEN floor(o_totalprice / 50) >= 500 THEN 3 ELSE 2 END AS SMALLINT) AS fire,
  CAST(2 AS SMALLINT) AS hotspot,
  CAST(CASE WHEN o_orderkey % 71 >= 55 THEN 4 WHEN o_orderkey % 71 >= 40 THEN 3
       WHEN o_orderkey % 71 >= 30 THEN 2 ELSE 1 END AS SMALLINT) AS quake,
  CAST(o_orderkey % 4 + 1 AS SMALLINT) AS warning FROM orders"""


def export_rows(spark, d):
    out = export.export_rows(hazards(spark, d), "ign")
    return out.select(
        "id", "source", "hazard_type", "external_id", "severity", "starts_at", "ends_at",
        F.round(F.col("geom.minx") * 1000).cast("bigint").alias("lon_m"),
        F.round(F.col("geom.miny") * 1000).cast("bigint").alias("lat_m"), "attrs",
    )


EXPORT_SQL = f"""WITH {HZ} SELECT id, source, hazard_type, external_id, severity, starts_at,
  ends_at, lon_m, lat_m, attrs FROM hz WHERE source = 'ign'"""


def to_feature_rows(spark, d):
    """GeoJSON features of every event, read back for comparison of their members."""
    f = F.col("feature")

    def member(path):
        return F.get_json_object(f, path)

    return export.to_feature_rows(hazards(spark, d)).select(
        "id",
        member("$.id").alias("feature_id"),
        member("$.geometry.type").alias("geometry_type"),
        member("$.properties.external_id").alias("external_id"),
        member("$.properties.severity").cast("int").alias("severity"),
        member("$.properties.starts_at").alias("starts_at"),
        member("$.properties.ends_at").alias("ends_at"),
        member("$.properties.attrs").alias("attrs"),
        F.round(
            F.coalesce(
                member("$.geometry.coordinates[0][0][0][0]"),
                member("$.geometry.coordinates[0][0][0]"),
                member("$.geometry.coordinates[0]"),
            ).try_cast("double")
            * 1000
        )
        .cast("bigint")
        .alias("first_lon_m"),
    )


FEATURES_SQL = f"""WITH {HZ} SELECT id, id AS feature_id,
  CASE WHEN source = 'ign' OR kind = 'hotspot' THEN 'Point'
       WHEN key % 12 = 9 AND source = 'effis' THEN 'MultiPolygon' ELSE 'Polygon'
  END AS geometry_type, external_id, CAST(severity AS INTEGER) AS severity,
  strftime(starts_at, '%Y-%m-%dT%H:%M:%SZ') AS starts_at,
  strftime(ends_at, '%Y-%m-%dT%H:%M:%SZ') AS ends_at, attrs,
  CAST(CASE WHEN source = 'ign' OR kind = 'hotspot' THEN lon_m
            WHEN source = 'effis' THEN lon_m - h ELSE zx - 500 END AS BIGINT) AS first_lon_m
FROM hz"""


def provinces_table(spark, d):
    return provinces(spark, d).select(
        "province_code", "name",
        F.round(F.col("geom.minx") * 1000).cast("bigint").alias("west_m"),
        F.round(F.col("geom.maxy") * 1000).cast("bigint").alias("north_m"),
    )


PROVINCES_OUT_SQL = f"""WITH {PROVINCES_SQL}
SELECT province_code, name, CAST(x0 AS BIGINT) AS west_m, CAST(y0 + 1600 AS BIGINT) AS north_m
FROM pv ORDER BY province_code"""

ACTIVE_AT = f"TIMESTAMP '{MOMENT:%Y-%m-%d %H:%M:%S}'"

QUERIES = {
    "burned_area_by_month": burned_area_by_month,
    "burned_area_one_province": burned_area_one_province,
    "plane_parity": plane_parity,
    "quake_frequency": quake_frequency,
    "quake_frequency_min": quake_frequency_min,
    "warnings_summary": warnings_summary,
    "warnings_summary_code": warnings_summary_code,
    "count_by_source": count_by_source,
    "apply_filters": apply_filters,
    "active_events": active_events,
    "filter_bbox": filter_bbox,
    "page_after": page_after,
    "stored_page": stored_page,
    "events_by_ids": events_by_ids,
    "check_domain": check_domain,
    "backfill_instants": backfill_instants,
    "severities": severities,
    "export_rows": export_rows,
    "to_feature_rows": to_feature_rows,
    "prepare_provinces": provinces_table,
}

ORACLES = {
    "burned_area_by_month": _burned_sql(""),
    "burned_area_one_province": _burned_sql("AND province_code = '42'"),
    "plane_parity": PARITY_SQL,
    "quake_frequency": _quake_sql(0.0),
    "quake_frequency_min": _quake_sql(4.5),
    "warnings_summary": _warnings_sql(""),
    "warnings_summary_code": _warnings_sql(
        "AND split_part(json_extract_string(attrs, '$.phenomenon'), ';', 1) = 'AT'"
    ),
    "count_by_source": f"WITH {HZ} SELECT source, count(*) AS events FROM hz GROUP BY 1",
    "apply_filters": f"""WITH {HZ} SELECT id, source, severity, starts_at FROM hz
WHERE hazard_type IN ('wildfire', 'weather_warning') AND severity >= 3
  AND starts_at >= TIMESTAMP '{SPAN[0]:%Y-%m-%d %H:%M:%S}'
  AND starts_at <= TIMESTAMP '{SPAN[1]:%Y-%m-%d %H:%M:%S}'""",
    "active_events": f"""WITH {HZ} SELECT id, starts_at, ends_at FROM hz
WHERE source = 'effis' AND starts_at <= {ACTIVE_AT}
  AND (ends_at IS NULL OR ends_at >= {ACTIVE_AT})""",
    "filter_bbox": BBOX_SQL,
    "page_after": PAGE_SQL,
    "stored_page": STORED_PAGE_SQL,
    "events_by_ids": IDS_SQL,
    "check_domain": f"""WITH {HZ} SELECT key, CASE WHEN key % 101 = 5 THEN 'source'
  WHEN key % 103 = 7 THEN 'hazard_type' WHEN key % 107 = 9 THEN 'severity' END AS problem
FROM hz""",
    "backfill_instants": f"""WITH {HZ} SELECT id, source, starts_at,
  CASE WHEN source = 'ign' OR kind = 'hotspot' THEN starts_at END AS ends_at FROM hz""",
    "severities": SEVERITIES_SQL,
    "export_rows": EXPORT_SQL,
    "to_feature_rows": FEATURES_SQL,
    "prepare_provinces": PROVINCES_OUT_SQL,
}
