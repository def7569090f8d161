"""Hazard tables derived from the given tables, row by row and in integer arithmetic.

``orders`` carries events (kind, place, window and attributes follow from the keys), ``events``
carries daily polls, ``nation`` carries an area tessellation. The ``*_SQL`` texts say the same
in the SQL dialect of the correctness check.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from emberlake.functions import geometry, severity, values
from emberlake.session import apply_runtime_conf, shared_folder
from emberlake.sources import snapshot

# Attribute vocabularies of the derived events.
PHENOMENA = ("AT;Temperaturas máximas", "VI;Viento", "PP;Lluvias", "NE;Nevadas")
LEVELS = ("amarillo", "naranja", "rojo")
ZONES = 40
FIRE_CLASSES = ("1DAY", "7DAYS_D", "7DAYS_N")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_runtime_conf(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _milli(c: Column) -> Column:
    return c.cast("double") / F.lit(1000.0)


def _pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _ring(*corners: tuple[Column, Column]) -> Column:
    return F.array(
        *[geometry.vertex(_milli(x), _milli(y)) for x, y in (*corners, corners[0])]
    )


def _square(x: Column, y: Column, h: Column) -> Column:
    return _ring((x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h))


_SNAPSHOTS: dict[tuple[str, str, bool], str] = {}


EXTRA = [T.StructField("key", T.LongType()), T.StructField("custkey", T.LongType())]


def hazards_root(spark: SparkSession, sf_dir: str, clumped: bool = False) -> str:
    """Folder of the derived events as a stored snapshot, written once per application and table folder."""
    slot = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), clumped)
    if slot not in _SNAPSHOTS or not snapshot.versions(spark, _SNAPSHOTS[slot]):
        root = shared_folder(spark, "hazards")
        snapshot.write_snapshot(derive_hazards(spark, sf_dir, clumped), root, version=0)
        _SNAPSHOTS[slot] = root
    return _SNAPSHOTS[slot]


def hazards(
    spark: SparkSession, sf_dir: str, clumped: bool = False, **pruning
) -> DataFrame:
    """The derived events out of the snapshot. ``source``, ``years`` and ``bbox`` prune its files."""
    root = hazards_root(spark, sf_dir, clumped)
    return snapshot.read_snapshot(apply_runtime_conf(spark), root, extra=EXTRA, **pruning)


def derive_hazards(spark: SparkSession, sf_dir: str, clumped: bool = False) -> DataFrame:
    """Events with the snapshot columns plus ``key`` and ``custkey``.

    ``clumped`` places them around fifty centres instead of on an even lattice.
    """
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderdate").cast("timestamp").alias("day"),
    )
    k, c = F.col("key"), F.col("custkey") % 50
    if clumped:
        lon = -9000 + (c * 7919) % 12000 + (k * 31) % 101 - 50
        lat = 36300 + (c * 104729) % 7200 + (k * 17) % 97 - 48
    else:
        lon = -9500 + (k * 7919) % 12900
        lat = 36000 + (k * 104729) % 7800
    six = k % 6
    base = o.select(
        "key",
        "custkey",
        (F.col("day") + F.make_dt_interval(hours=k % 24, mins=k % 60)).alias("starts_at"),
        lon.alias("lon_m"),
        lat.alias("lat_m"),
        (1 + k % 20).alias("h"),
        F.when(six == 0, "hotspot").when(six == 3, "burnt_area").alias("kind"),
        F.when(k % 3 == 0, "effis").when(k % 3 == 1, "ign").otherwise("aemet").alias("source"),
        F.floor(k / 3).alias("k3"),
        F.floor(k / 9).alias("k9"),
    )
    tenths = 10 + (k * 13) % 60
    zone = k % ZONES
    zx, zy = -9000 + (zone % 8) * 1500, 36500 + F.floor(zone / 8) * 1400
    x, y, h = F.col("lon_m"), F.col("lat_m"), F.col("h")
    area = F.when(F.col("kind") == "burnt_area", 30 + (k * 37) % 6000)
    magnitude = F.when(
        k % 17 != 0,
        F.concat_ws(".", F.floor(tenths / 10).cast("string"), (tenths % 10).cast("string")),
    )
    src = F.col("source")
    twin = k % 12 == 9
    geom = (
        F.when((src == "ign") | (F.col("kind") == "hotspot"), geometry.point(_milli(x), _milli(y)))
        .when(
            (src == "effis") & twin,
            geometry.from_parts(
                F.lit(geometry.MULTIPOLYGON),
                F.array(F.array(_square(x, y, h)), F.array(_square(x + 4 * h, y, h))),
            ),
        )
        .when(
            src == "effis",
            geometry.from_parts(F.lit(geometry.POLYGON), F.array(F.array(_square(x, y, h)))),
        )
        .otherwise(
            geometry.from_parts(
                F.lit(geometry.POLYGON),
                F.array(
                    F.array(
                        _ring(
                            (zx - 500, zy - 400),
                            (zx + 300, zy - 400),
                            (zx + 500, zy + 400),
                            (zx - 300, zy + 400),
                        )
                    )
                ),
            )
        )
    )
    quake_attrs = F.to_json(
        F.struct(
            magnitude.alias("magnitude"), F.concat(F.lit("REGION "), (k % 7).cast("string")).alias("region")
        )
    )
    fire_attrs = F.to_json(
        F.struct(
            F.col("kind").alias("kind"),
            F.when(F.col("kind") == "hotspot", _pick(FIRE_CLASSES, F.col("k3") % 3)).alias("class"),
            area.alias("area_ha"),
        )
    )
    warning_attrs = F.to_json(
        F.struct(
            F.when(F.col("k9") % 5 != 4, _pick(PHENOMENA, F.col("k9") % 5)).alias("phenomenon"),
            _pick(LEVELS, F.col("k3") % 3).alias("level"),
            F.concat(F.lit("7"), F.lpad(zone.cast("string"), 5, "0")).alias("zone"),
        )
    )
    expires = F.col("starts_at") + F.make_dt_interval(hours=k % 48 + 1)
    faded = F.col("starts_at") + F.make_dt_interval(days=k % 90 + 1)
    ends = values.instant_end(src, F.col("kind"), F.col("starts_at"), expires)
    external = F.concat(
        F.when(src == "ign", "es").when(src == "aemet", "cap-").when(six == 0, "hs-").otherwise("ba-"),
        k.cast("string"),
    )
    grade = (
        F.when(src == "effis", severity.wildfire_severity(F.col("kind"), area.cast("double")))
        .when(src == "ign", severity.quake_severity(magnitude.cast("double")))
        .otherwise(severity.warning_severity(_pick(LEVELS, F.col("k3") % 3)))
    )
    return base.select(
        values.event_id(src, external).alias("id"),
        "source",
        F.when(src == "effis", "wildfire")
        .when(src == "ign", "earthquake")
        .otherwise("weather_warning")
        .alias("hazard_type"),
        external.alias("external_id"),
        grade.alias("severity"),
        "starts_at",
        F.when((six == 3) & (k % 4 == 1), faded).otherwise(ends).alias("ends_at"),
        geom.alias("geom"),
        F.when(src == "effis", fire_attrs)
        .when(src == "ign", quake_attrs)
        .otherwise(warning_attrs)
        .alias("attrs"),
        "key",
        "custkey",
    )


def _sql_list(names: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def hazards_sql(clumped: bool = False) -> str:
    """CTE ``hz`` with the event columns; geometry stays as its integer ingredients."""
    if clumped:
        lon = "-9000 + ((o_custkey % 50) * 7919) % 12000 + (o_orderkey * 31) % 101 - 50"
        lat = "36300 + ((o_custkey % 50) * 104729) % 7200 + (o_orderkey * 17) % 97 - 48"
    else:
        lon = "-9500 + (o_orderkey * 7919) % 12900"
        lat = "36000 + (o_orderkey * 104729) % 7800"
    return f"""
hz0 AS (
  SELECT o_orderkey AS key, o_custkey AS custkey,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER))
                     + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS starts_at,
         {lon} AS lon_m, {lat} AS lat_m, 1 + o_orderkey % 20 AS h,
         CASE o_orderkey % 6 WHEN 0 THEN 'hotspot' WHEN 3 THEN 'burnt_area' END AS kind,
         CASE o_orderkey % 3 WHEN 0 THEN 'effis' WHEN 1 THEN 'ign' ELSE 'aemet' END AS source,
         10 + (o_orderkey * 13) % 60 AS tenths, o_orderkey % {ZONES} AS zone,
         30 + (o_orderkey * 37) % 6000 AS area_ha
  FROM orders),
hz1 AS (
  SELECT *,
         CASE WHEN key % 17 <> 0 THEN (tenths // 10) || '.' || (tenths % 10) END AS magnitude,
         CASE WHEN (key // 9) % 5 <> 4
              THEN {_sql_list(PHENOMENA)}[(key // 9) % 5 + 1] END AS phenomenon,
         {_sql_list(LEVELS)}[(key // 3) % 3 + 1] AS level,
         '7' || lpad(CAST(zone AS VARCHAR), 5, '0') AS zone_code,
         -9000 + (zone % 8) * 1500 AS zx, 36500 + (zone // 8) * 1400 AS zy,
         CASE WHEN source = 'ign' THEN 'es' WHEN source = 'aemet' THEN 'cap-'
              WHEN key % 6 = 0 THEN 'hs-' ELSE 'ba-' END || key AS external_id
  FROM hz0),
hz AS (
  SELECT *, CASE source WHEN 'effis' THEN 'wildfire' WHEN 'ign' THEN 'earthquake'
                        ELSE 'weather_warning' END AS hazard_type,
         CAST(CASE WHEN source = 'effis' AND kind = 'hotspot' THEN 2
                   WHEN source = 'effis' THEN CASE WHEN area_ha >= 5000 THEN 4
                                                   WHEN area_ha >= 500 THEN 3 ELSE 2 END
                   WHEN source = 'ign' THEN CASE WHEN magnitude IS NULL THEN 1
                        WHEN tenths >= 55 THEN 4 WHEN tenths >= 40 THEN 3
                        WHEN tenths >= 30 THEN 2 ELSE 1 END
                   ELSE CASE level WHEN 'amarillo' THEN 2 WHEN 'naranja' THEN 3 ELSE 4 END
              END AS SMALLINT) AS severity,
         CASE WHEN source = 'ign' OR kind = 'hotspot' THEN starts_at
              WHEN source = 'aemet' THEN starts_at + to_hours(CAST(key % 48 + 1 AS INTEGER))
              WHEN key % 4 = 1 THEN starts_at + to_days(CAST(key % 90 + 1 AS INTEGER))
         END AS ends_at,
         CASE WHEN source = 'ign' THEN
                '{{' || coalesce('"magnitude":"' || magnitude || '",', '')
                     || '"region":"REGION ' || (key % 7) || '"}}'
              WHEN kind = 'hotspot' THEN '{{"kind":"hotspot","class":"'
                     || {_sql_list(FIRE_CLASSES)}[(key // 3) % 3 + 1] || '"}}'
              WHEN source = 'effis' THEN
                '{{"kind":"burnt_area","area_ha":' || area_ha || '}}'
              ELSE '{{' || coalesce('"phenomenon":"' || phenomenon || '",', '')
                     || '"level":"' || level || '","zone":"' || zone_code || '"}}' END AS attrs,
         regexp_replace(substr(sha256(source || '|' || external_id), 1, 32),
                        '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS id
  FROM hz1)"""


# Column boundaries of the tessellation lean to the east going north.
COLUMN_MILLI, ROW_MILLI, LEAN_MILLI = 2600, 1600, 300
WEST_MILLI, SOUTH_MILLI = -9801, 35901


def national_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw area table: national code, name and outline, five columns by five rows."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("bigint")
    col, row = k % 5, F.floor(k / 5)
    x = WEST_MILLI + col * COLUMN_MILLI
    y = SOUTH_MILLI + row * ROW_MILLI

    def lean(level):
        return level * LEAN_MILLI

    ring = _ring(
        (x + lean(row), y),
        (x + lean(row) + COLUMN_MILLI, y),
        (x + lean(row + 1) + COLUMN_MILLI, y + ROW_MILLI),
        (x + lean(row + 1), y + ROW_MILLI),
    )
    code = F.lpad((k + 30).cast("string"), 2, "0")
    return n.select(
        F.concat(F.lit("34"), F.lpad((k % 17 + 1).cast("string"), 2, "0"), code, F.lit("00000")).alias(
            "national_code"
        ),
        F.col("n_name").alias("name"),
        geometry.from_parts(F.lit(geometry.POLYGON), F.array(F.array(ring))).alias("geom"),
    )


# Same areas as half-planes: a position is within when it lies strictly between the two leaning
# sides and the two level ones. `px`, `py` are milli-degrees.
PROVINCES_SQL = f"""
pv AS (
  SELECT lpad(CAST(n_nationkey + 30 AS VARCHAR), 2, '0') AS province_code, n_name AS name,
         {WEST_MILLI} + (n_nationkey % 5) * {COLUMN_MILLI}
           + (n_nationkey // 5) * {LEAN_MILLI} AS x0,
         {SOUTH_MILLI} + (n_nationkey // 5) * {ROW_MILLI} AS y0
  FROM nation WHERE n_nationkey + 30 <> 54)"""

WITHIN_SQL = (
    "py > y0 AND py < y0 + {r} AND (px - x0) * {r} > (py - y0) * {l} "
    "AND (px - x0 - {c}) * {r} < (py - y0) * {l}"
).format(r=ROW_MILLI, l=LEAN_MILLI, c=COLUMN_MILLI)


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full-set poll per day: the events of that day, in order of arrival.

    ``poll_no`` numbers the days; a key may occur several times within a poll.
    """
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.lit("effis").alias("source"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).cast("bigint").alias("poll_no"),
        day.cast("timestamp").alias("poll_ts"),
        F.concat(F.lit("ba-"), F.col("user_id").cast("string")).alias("external_id"),
        F.col("event_id").alias("ordinal"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "event_type",
    )


POLLS_SQL = """
polls AS (
  SELECT 'effis' AS source, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS poll_no,
         CAST(CAST(ts AS DATE) AS TIMESTAMP) AS poll_ts, 'ba-' || user_id AS external_id,
         event_id AS ordinal, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type
  FROM events)"""


# Corner coordinates of the audited rings: small integers, distinct along the ring.
_CORNERS = ((7, 31, 3, 0), (13, 5, 17, 1), (29, 11, 41, 2), (37, 23, 53, 3))


def derive_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed ring of four corners per line item: plain, twisted or flat."""
    identity = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = table(spark, sf_dir, "lineitem").select(*identity).distinct()
    p, q = F.col("l_partkey"), F.col("l_orderkey") + F.col("l_linenumber")

    def corner(a, b, c, i):
        x = 4 * ((p * a + q * b) % 9) + i
        y = (p * c + q * a) % 11
        return geometry.vertex(x, y)

    corners = [corner(*k) for k in _CORNERS]
    return li.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in identity]).alias("key"),
        F.array(*corners, corners[0]).alias("ring"),
    )


def _rings_sql() -> str:
    cols = ", ".join(
        f"4 * ((p * {a} + q * {b}) % 9) + {i} AS x{i}, (p * {c} + q * {a}) % 11 AS y{i}"
        for a, b, c, i in _CORNERS
    )

    def side(p, q, r):
        return f"sign((x{q} - x{p}) * (y{r} - y{p}) - (y{q} - y{p}) * (x{r} - x{p}))"

    def meet(a, b, c, d):
        boxes = " AND ".join(
            f"least({v}{a}, {v}{b}) <= greatest({v}{c}, {v}{d}) "
            f"AND least({v}{c}, {v}{d}) <= greatest({v}{a}, {v}{b})"
            for v in "xy"
        )
        return (
            f"({boxes} AND {side(a, b, c)} * {side(a, b, d)} <= 0 "
            f"AND {side(c, d, a)} * {side(c, d, b)} <= 0)"
        )

    def fold(a, b, c):
        return (
            f"((x{b} - x{a}) * (y{c} - y{b}) = (y{b} - y{a}) * (x{c} - x{b}) AND "
            f"(x{b} - x{a}) * (x{c} - x{b}) + (y{b} - y{a}) * (y{c} - y{b}) < 0)"
        )

    def lobes(a, b, c, d, axis=None):
        den = f"((x{b} - x{a}) * (y{d} - y{c}) - (y{b} - y{a}) * (x{d} - x{c}))"
        t = f"((x{c} - x{a}) * (y{d} - y{c}) - (y{c} - y{a}) * (x{d} - x{c})) / CAST({den} AS DOUBLE)"
        px, py = f"(x{a} + {t} * (x{b} - x{a}))", f"(y{a} + {t} * (y{b} - y{a}))"

        def tri(i, j):
            size = f"abs((x{i} - {px}) * (y{j} - {py}) - (y{i} - {py}) * (x{j} - {px})) / 2"
            return size if axis is None else f"{size} * ({axis}{i} + {axis}{j} + {px if axis == 'x' else py}) / 3"

        return f"CASE WHEN {den} = 0 THEN 0 ELSE {tri(b, c)} + {tri(d, a)} END"

    shoelace = " + ".join(f"x{i} * y{j} - x{j} * y{i}" for i, j in ((0, 1), (1, 2), (2, 3), (3, 0)))
    def moment(axis):
        turns = ((0, 1), (1, 2), (2, 3), (3, 0))
        plain = " + ".join(f"({axis}{i} + {axis}{j}) * (x{i} * y{j} - x{j} * y{i})" for i, j in turns)
        return f"""CASE WHEN m1 THEN {lobes(0, 1, 2, 3, axis)} WHEN m2 THEN {lobes(1, 2, 3, 0, axis)}
       ELSE sign({shoelace}) * ({plain}) / 6.0 END"""

    first, second = meet(0, 1, 2, 3), meet(1, 2, 3, 0)
    folds = " + ".join(f"CAST({fold(*k)} AS INTEGER)" for k in ((0, 1, 2), (1, 2, 3), (2, 3, 0), (3, 0, 1)))
    return f"""WITH k AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  l_partkey AS p, l_orderkey + l_linenumber AS q FROM lineitem),
c AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS key,
  {cols} FROM k),
f AS (SELECT *, {first} AS m1, {second} AS m2, {folds} AS nf FROM c),
g AS (SELECT key, CAST(m1 AS INTEGER) + CAST(m2 AS INTEGER) + nf AS crossings,
  CASE WHEN m1 THEN {lobes(0, 1, 2, 3)} WHEN m2 THEN {lobes(1, 2, 3, 0)}
       ELSE abs({shoelace}) / 2.0 END AS area, {moment("x")} AS mx, {moment("y")} AS my FROM f)
SELECT key, crossings, crossings > 0 AS crossing, round(area + 1.3e-7, 6) AS area, area < 1e-9 AS empty,
  CASE WHEN area >= 1e-9 THEN round(mx / area + 1.3e-7, 6) END AS x,
  CASE WHEN area >= 1e-9 THEN round(my / area + 1.3e-7, 6) END AS y FROM g"""


def derive_long_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One closed ring of 28 to 68 corners per customer: a zigzag out and its mirror image back, which cross between all corners."""
    k = F.col("c_custkey")
    m, wide, high = 13 + k % 21, 1 + k % 5, 2 + k % 3

    def way(steps, turn):
        return F.transform(
            steps, lambda i: geometry.vertex(k % 100 + wide * i, k % 70 + high * F.when(i % 2 == turn, 1).otherwise(0))
        )

    out = way(F.sequence(F.lit(0).cast("bigint"), m), 1)
    back = way(F.sequence(m, F.lit(0).cast("bigint")), 0)
    ring = F.concat(out, back, F.slice(out, 1, 1))
    # a file of short rows makes few tasks, and the rings are many times as long
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")
    return keys.select(k.cast("string").alias("key"), ring.alias("ring"))


LONG_RINGS_SQL = """WITH k AS (SELECT c_custkey AS k, 13 + c_custkey % 21 AS m, 1 + c_custkey % 5 AS wide, 2 + c_custkey % 3 AS high
  FROM customer)
SELECT CAST(k AS VARCHAR) AS key, m AS crossings, true AS crossing, round(m * wide * high / 2.0::DOUBLE, 6) AS area, false AS empty,
  round(k % 100 + m * wide / 2.0::DOUBLE, 6) AS x, round(k % 70 + high / 2.0::DOUBLE, 6) AS y FROM k"""

RINGS_SQL = _rings_sql()
