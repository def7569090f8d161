"""Golden cases of the reports, listing, radius search and export."""

import datetime as dt
import json
import math
import random

import pytest
from helpers import BASE, distance, event, events_frame, point, polygon, square
from pyspark.sql import functions as F

from emberlake import schemas
from emberlake.operators import checks, export, filters, grid, near, reports, spatial_join
from emberlake.sources import provinces, snapshot
from emberlake.session import shared_folder

UTC = dt.timezone.utc


def at(month, year=2026, day=10):
    return dt.datetime(year, month, day, tzinfo=UTC)


@pytest.fixture(scope="module")
def areas(spark):
    rows = [("24", "León", square(0, 0, 5)), ("28", "Madrid", square(10, 0, 5))]
    return spark.createDataFrame(rows, schemas.PROVINCES)


def fire(name, lon, lat, area, when, kind="burnt_area"):
    attrs = {"kind": kind} | ({"area_ha": area} if area is not None else {})
    return event(name, square(lon, lat, 0.5), starts_at=when, attrs=json.dumps(attrs))


@pytest.fixture(scope="module")
def fires(spark):
    return events_frame(
        spark,
        [
            fire("a", 0, 0, 820.0, at(7)),
            fire("b", 1, 1, 100.0, at(8)),
            fire("c", 10, 0, 50.5, at(7)),
            fire("hot", 0, 0, None, at(7), kind="hotspot"),
            fire("old", 0, 0, 999.0, at(7, 2025)),
            fire("edge", 5, 0, 70.0, at(7)),  # centroid on the common border
        ],
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_burned_area(fires, areas):
    got = rows(reports.burned_area_by_month(fires, areas, year=2026))
    assert got == [("24", "León", 7, 1, 820.0), ("24", "León", 8, 1, 100.0), ("28", "Madrid", 7, 1, 50.5)]
    assert rows(reports.burned_area_by_month(fires, areas, year=2026, province_code="28")) == [got[2]]


def test_plane_parity(fires, areas):
    inside = fires.where((F.col("external_id") != "edge") & (F.col("external_id") != "old"))
    report = reports.burned_area_by_month(inside, areas, year=2026)
    assert rows(reports.plane_parity(inside, report)) == [(970.5, 970.5, True)]
    assert reports.plane_parity(fires, report).first()["agree"] is False


def quake(name, magnitude, when):
    attrs = json.dumps({"magnitude": magnitude} if magnitude is not None else {})
    return event(name, point(0, 0), source="ign", hazard_type="earthquake", starts_at=when, attrs=attrs)


def test_quake_frequency(spark):
    df = events_frame(
        spark, [quake("a", 2.5, at(1)), quake("b", 4.2, at(1)), quake("c", 3.1, at(3)), quake("d", None, at(3))]
    )
    assert rows(reports.quake_frequency(df, year=2026)) == [(1, 2, 4.2), (3, 1, 3.1)]
    assert rows(reports.quake_frequency(df, year=2026, min_magnitude=3.0)) == [(1, 1, 4.2), (3, 1, 3.1)]


def warning(name, code, level, zone):
    attrs = json.dumps({"phenomenon": code, "level": level, "zone": zone})
    return event(name, point(0, 0), source="aemet", hazard_type="weather_warning", starts_at=at(7), attrs=attrs)


def test_warnings_summary(spark):
    df = events_frame(
        spark,
        [
            warning("a", "AT;Temperaturas", "naranja", "1"),
            warning("b", "AT;Temperaturas", "naranja", "2"),
            warning("c", "AT;Temperaturas", "amarillo", "1"),
            warning("d", "VI;Viento", "amarillo", "1"),
        ],
    )
    got = rows(reports.warnings_summary(df, year=2026))
    assert got == [
        ("AT;Temperaturas", "amarillo", 1, 1), ("AT;Temperaturas", "naranja", 2, 2), ("VI;Viento", "amarillo", 1, 1)
    ]
    assert len(rows(reports.warnings_summary(df, year=2026, phenomenon_code="AT"))) == 2
    rough = rows(reports.warnings_summary(df, year=2026, approximate_zones=True))
    assert rough == got


def test_missing_snapshot_is_empty(spark, areas):
    nothing = snapshot.read_snapshot(spark, shared_folder(spark, "none"))
    assert rows(reports.burned_area_by_month(nothing, areas, year=2026)) == []
    assert rows(reports.quake_frequency(nothing, year=2026)) == []
    assert rows(reports.warnings_summary(nothing, year=2026)) == []


def test_unfinished_version_is_ignored(spark, fires, tmp_path):
    root = str(tmp_path / "snap")
    snapshot.write_snapshot(fires.select(*schemas.SNAPSHOT.fieldNames()), root, version=1)
    (tmp_path / "snap" / "files" / "v=2").mkdir()
    assert snapshot.versions(spark, root) == [1]
    assert snapshot.read_snapshot(spark, root).count() == 6
    assert snapshot.read_snapshot(spark, root, years=(2025, 2025)).count() == 1
    assert snapshot.read_snapshot(spark, root).schema["ends_at"].dataType == schemas.SNAPSHOT["ends_at"].dataType


@pytest.mark.parametrize(
    "call",
    [
        lambda f, a: reports.quake_frequency(f, year=1999),
        lambda f, a: reports.quake_frequency(f, year=2026, min_magnitude=11),
        lambda f, a: reports.warnings_summary(f, year=2026, phenomenon_code="at"),
        lambda f, a: reports.burned_area_by_month(f, a, year=2026, province_code="7"),
        lambda f, a: filters.filter_bbox(f, (3, 0, 1, 1)),
        lambda f, a: filters.filter_bbox(f, (0, 0, 1)),
        lambda f, a: filters.apply_filters(f, severity_min=5),
        lambda f, a: filters.page_after(f, limit=0),
        lambda f, a: near.near(f, lon=0, lat=0, radius_m=250_000),
        lambda f, a: near.near(f, lon=190, lat=0, radius_m=10),
    ],
)
def test_arguments_are_checked_before_any_job(fires, areas, call):
    with pytest.raises(ValueError):
        call(fires, areas)


def test_ceilings_can_be_raised(spark, fires):
    with checks.overridden(max_limit=5000, years=(1900, 2100), max_radius_m=1e6):
        assert filters.page_after(fires, limit=2000).count() == 6
        assert rows(reports.quake_frequency(fires, year=1995)) == []
        with pytest.raises(ValueError):
            filters.page_after(fires, limit=6000)
    with pytest.raises(ValueError):
        filters.page_after(fires, limit=2000)


def test_lookup_reads_the_events_once(spark, fires):
    ids = spark.createDataFrame([(r["id"],) for r in fires.select("id").limit(2).collect()] * 2 + [("none",)], "id string")
    found, missing = filters.events_by_ids(fires, ids)
    assert found.count() == 2 and found.columns == fires.columns
    assert [r["id"] for r in missing.collect()] == ["none"]


def test_active_windows(spark):
    now = BASE
    hour = dt.timedelta(hours=1)
    df = events_frame(
        spark,
        [
            event("open", point(0, 0), starts_at=now - hour),
            event("instant", point(0, 0), starts_at=now - hour, ends_at=now - hour),
            event("covering", point(0, 0), starts_at=now - hour, ends_at=now + hour),
            event("past", point(0, 0), starts_at=now - 3 * hour, ends_at=now - hour),
            event("future", point(0, 0), starts_at=now + hour),
        ],
    )
    got = {r["external_id"] for r in filters.apply_filters(df, active_at=now).collect()}
    assert got == {"open", "covering"}
    assert filters.apply_filters(df, hazard_types=[]).count() == 5


def test_keyset_pages_visit_everything_once(spark):
    df = events_frame(spark, [event(f"e{i}", point(0, 0), hours=i // 2) for i in range(7)])
    seen, key = [], None
    while True:
        page = filters.page_after(df, limit=2, after=key).collect()
        seen += [r["external_id"] for r in page[:2]]
        key = filters.next_key(page, 2)
        if key is None:
            break
        key = (key[0].replace(tzinfo=UTC) if key[0].tzinfo is None else key[0], key[1])
    assert sorted(seen) == [f"e{i}" for i in range(7)]


def test_backfill_and_domain(spark):
    hot = json.dumps({"kind": "hotspot"})
    df = events_frame(
        spark,
        [
            event("q", point(0, 0), source="ign", hazard_type="earthquake"),
            event("h", point(0, 0), attrs=hot),
            event("b", point(0, 0), attrs=json.dumps({"kind": "burnt_area"})),
            event("bad", point(0, 0), source="nasa"),
            event("worse", point(0, 0), severity=9),
        ],
    )
    ended = {r["external_id"]: r["ends_at"] is not None for r in filters.backfill_instants(df).collect()}
    assert ended == {"q": True, "h": True, "b": False, "bad": False, "worse": False}
    good, bad = filters.check_domain(df)
    assert good.count() == 3
    assert {r["external_id"]: r["problem"] for r in bad.collect()} == {"bad": "source", "worse": "severity"}


def seeded(spark):
    return events_frame(
        spark,
        [
            event("m0", point(-3.70, 40.42)),
            event("m1", point(-3.75, 40.42), severity=3),
            event("m2", point(-3.70, 40.46)),
            event("q", point(-3.71, 40.43), hazard_type="earthquake", source="ign"),
            event("toledo", point(-4.02, 39.86)),
            event("bcn", point(2.15, 41.39)),
            event("area", square(-3.60, 40.42, 0.02)),
            event("around", square(-3.70, 40.42, 1.0)),
        ],
    )


def test_radius_search(spark):
    df = seeded(spark)
    points = df.where(F.col("geom.kind") == "Point")
    got = near.near(points, lon=-3.70, lat=40.42, radius_m=10_000).collect()
    assert len(got) == 4 and got[0]["external_id"] == "m0" and got[0]["distance_m"] < 1
    assert [r["distance_m"] for r in got] == sorted(r["distance_m"] for r in got)
    far = near.near(points, lon=-3.70, lat=40.42, radius_m=100_000).collect()
    assert len(far) == 5 and 60_000 < far[-1]["distance_m"] < 75_000
    only = near.near(points, lon=-3.70, lat=40.42, radius_m=10_000, hazard_types=["wildfire"])
    assert {r["external_id"] for r in only.collect()} == {"m0", "m1", "m2"}


def test_polygon_distance_is_to_the_edge(spark):
    df = seeded(spark)
    got = {r["external_id"]: r["distance_m"] for r in near.near(df, lon=-3.70, lat=40.42, radius_m=10_000).collect()}
    assert got["around"] == 0.0
    assert abs(got["area"] - distance(point(-3.70, 40.42), square(-3.60, 40.42, 0.02))) < 1e-6


def test_many_centres_agree_with_single_searches(spark):
    df = seeded(spark)
    centres = [(i, -3.9 + 0.05 * i, 40.3 + 0.03 * i) for i in range(8)]
    table = spark.createDataFrame(centres, "centre_id long, lon double, lat double")
    got = {}
    for r in near.near_join(df, table, radius_m=15_000, limit=3).collect():
        got.setdefault(r["centre_id"], []).append((r["rank"], r["id"]))
    for i, lon, lat in centres:
        single = [r["id"] for r in near.near(df, lon=lon, lat=lat, radius_m=15_000, limit=3).collect()]
        assert [x for _, x in sorted(got.get(i, []))] == single


def test_places_are_found_once_and_without_sorting_nested_arrays(spark):
    places = near._first_per_place(seeded(spark), 3)
    executed = places._jdf.queryExecution().executedPlan()
    sorts = [line for line in executed.toString().splitlines() if "Sort [" in line]
    assert sorts and not any("parts" in line for line in sorts)
    # the partition keys are a hash and a text
    assert "cast(geom" in executed.toString() and "as string)" in executed.toString()
    plan = near._items(places, 15_000)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window [" in line for line in plan.splitlines()) == 1


def test_equal_places_keep_their_smallest_ids(spark):
    rows = [event(f"p{i}", point(-3.7, 40.4)) for i in range(5)] + [event(f"q{i}", point(-3.7, 40.4 + 1e-9)) for i in range(2)]
    df = events_frame(spark, rows + [event(f"a{i}", square(-3.7, 40.4, 1e-3)) for i in range(4)])
    groups = {}
    for r in df.collect():
        groups.setdefault(str(r["geom"]["parts"]), []).append(r["id"])
    kept = [r["id"] for r in near._first_per_place(df, 2).collect()]
    assert len(groups) == 3 and sorted(kept) == sorted(i for ids in groups.values() for i in sorted(ids)[:2])


def test_pairs_of_a_crowded_cell_are_bounded_by_the_limit(spark):
    """3,000 places and 40 areas within a hundred metres, centres among and beside them."""
    rnd = random.Random(11)
    rows = [event(f"p{i}", point(-3.7 + rnd.random() * 1e-3, 40.4 + rnd.random() * 1e-3)) for i in range(3000)]
    rows += [event(f"same{i}", point(-3.7, 40.4)) for i in range(200)]
    rows += [event(f"a{i}", square(-3.7 + rnd.random() * 1e-3, 40.4 + rnd.random() * 1e-3, 1e-5 * (1 + i))) for i in range(40)]
    df = events_frame(spark, rows).cache()
    centres = [(i, -3.7005 + 1e-4 * i, 40.4 + 5e-5 * i) for i in range(20)] + [(50, -3.75, 40.4), (51, -5.0, 40.4)]
    table = spark.createDataFrame(centres, "centre_id long, lon double, lat double")
    made = []
    original = near._candidates

    def counted(reached, leaves):
        pairs = original(reached, leaves).cache()
        made.extend(r["count"] for r in grid.spread_join(reached, leaves, ["level", *near.CELL], F.col("centre_id"))
                    .groupBy("centre_id").count().collect())
        return pairs

    limit = 10
    near._candidates = counted
    try:
        got = {}
        for r in near.near_join(df, table, radius_m=20_000, limit=limit).collect():
            got.setdefault(r["centre_id"], []).append((r["rank"], r["id"]))
    finally:
        near._candidates = original
    assert len(made) == 21 and max(made) <= 12 * limit
    items = [(r["id"], r["geom"]) for r in df.select("id", "geom").collect()]
    for i, lon, lat in centres:
        first = sorted((distance(point(lon, lat), g), k) for k, g in items)[:limit]
        want = [k for d, k in first if d <= 20_000]
        assert [k for _, k in sorted(got.get(i, []))] == want


def test_join_without_broadcast_salts_a_crowded_cell(spark, fires, areas, monkeypatch):
    from emberlake.operators import grid

    monkeypatch.setattr(grid, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(grid, "CROWDED_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rows(spatial_join.join_within(fires, areas).select("id", "province_code"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 5 and len(set(got)) == 5


def test_a_long_outline_is_cut_from_strips_to_cells(spark):
    rnd = random.Random(5)
    corners = 4000
    ring = []
    for i in range(corners):
        turn, reach = 2 * math.pi * i / corners, rnd.uniform(5.0, 9.0)
        ring.append((reach * math.cos(turn), 40 + reach * math.sin(turn)))
    coast = spark.createDataFrame([("01", "Coast", polygon(*ring))], schemas.PROVINCES)
    spots = [(rnd.uniform(-9, 9), rnd.uniform(31, 49)) for _ in range(300)]
    events = events_frame(spark, [event(f"p{i}", point(*p)) for i, p in enumerate(spots)])

    def odd(x, y):
        inside = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
                inside = not inside
        return inside

    placed = events.select("id", F.col("external_id").alias("name")).join(spatial_join.join_within(events, coast), "id")
    got = {r["name"] for r in placed.collect()}
    assert got == {f"p{i}" for i, p in enumerate(spots) if odd(*p)} and 0 < len(got) < 300
    cells = spatial_join.area_cells(coast, ["province_code"])
    assert cells.count() == cells.select("cx", "cy").distinct().count()
    assert cells.where("near_edges is null").count() > 0


def test_prepare_provinces(spark):
    g = square(0, 0, 1)
    raw = spark.createDataFrame(
        [("34172800000", "Madrid", g), ("34015400000", "Islotes", g), ("34070500000", "Ávila", g)],
        "national_code string, name string, geom " + schemas.GEOMETRY.simpleString(),
    )
    assert [r["province_code"] for r in provinces.prepare_provinces(raw).collect()] == ["05", "28"]


def test_features(spark):
    df = events_frame(spark, [event("x\"y", polygon((0, 0), (1, 0), (1, 1)), attrs='{"kind":"burnt_area","area_ha":3.5}')])
    feature = json.loads(export.to_feature_rows(df).first()["feature"])
    assert feature["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]}
    assert feature["properties"]["external_id"] == 'x"y'
    assert feature["properties"]["attrs"] == {"kind": "burnt_area", "area_ha": 3.5}
    assert feature["properties"]["ends_at"] is None and feature["properties"]["severity"] == 2
    hit = near.near(df, lon=0.5, lat=0.2, radius_m=1000)
    assert json.loads(export.to_feature_rows(hit).first()["feature"])["properties"]["distance_m"] == 0.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cartesian_or_nested_loop_joins(spark, fires, areas):
    table = spark.createDataFrame([(1, 0.0, 40.0)], "centre_id long, lon double, lat double")
    for df in (
        reports.burned_area_by_month(fires, areas, year=2026),
        near.near_join(fires, table, radius_m=1000),
        spatial_join.join_within(fires, areas),
    ):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


@pytest.fixture(scope="module")
def spread(spark, tmp_path_factory):
    """Three years of events all over a 40 x 40 degree field, and the snapshot that stores them."""
    rnd = random.Random(3)
    rows = [
        event(f"e{i}", point(rnd.uniform(-20, 20), rnd.uniform(20, 60)), starts_at=at(1 + i % 12, 2023 + i % 3, 1 + i % 28))
        for i in range(900)
    ]
    df = events_frame(spark, rows).select(*schemas.SNAPSHOT.fieldNames()).cache()
    root = str(tmp_path_factory.mktemp("spread") / "snap")
    snapshot.write_snapshot(df, root, version=0, files=72)
    return df, root


def test_a_box_opens_only_the_files_around_it(spark, spread):
    df, root = spread
    files = snapshot.files_of(spark, root, 0).count()
    for box in ((3, 40, 4, 41), (-20, 20, 20, 60), (100, 0, 101, 1)):
        got = snapshot.read_snapshot(spark, root, bbox=box)
        assert {r["id"] for r in got.collect()} == {r["id"] for r in filters.filter_bbox(df, box).collect()}
    opened = len(snapshot.read_snapshot(spark, root, bbox=(3, 40, 4, 41)).inputFiles())
    assert files >= 60 and 0 < opened <= files // 4
    only = snapshot.read_snapshot(spark, root, bbox=(3, 40, 4, 41), years=(2024, 2024)).inputFiles()
    assert len(only) <= files // 8 and all("year=2024" in f for f in only)


def test_a_page_opens_one_year_when_that_fills_it(spark, spread):
    df, root = spread
    key, seen = None, []
    page = snapshot.read_page(spark, root, limit=100)
    assert {f.split("year=")[1][:4] for f in page.inputFiles()} == {"2025"}
    while True:
        got = snapshot.read_page(spark, root, limit=100, after=key).select("starts_at", "id").collect()
        key = filters.next_key(got, 100)
        seen += [r["id"] for r in got[:100]]
        if key is None:
            break
    want = df.orderBy(F.desc("starts_at"), F.desc("id")).select("id").collect()
    assert seen == [r["id"] for r in want]
    assert snapshot.read_page(spark, root + "-none").count() == 0


def test_filters_reach_the_scan(spark, fires, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    root = str(tmp_path / "scan")
    snapshot.write_snapshot(fires.select(*schemas.SNAPSHOT.fieldNames()), root, version=0)
    stored = snapshot.read_snapshot(spark, root)
    text = plan(filters.filter_bbox(filters.apply_filters(stored, severity_min=2, starts_after=at(1)), (0, 0, 1, 1)))
    pushed = text[text.index("PushedFilters"):]
    for piece in ("LessThanOrEqual(geom.minx,1.0)", "GreaterThanOrEqual(geom.maxy,0.0)", "severity,2", "starts_at"):
        assert piece in pushed
    year = plan(reports.quake_frequency(snapshot.read_snapshot(spark, root, source="effis", years=(2026, 2026)), year=2026))
    assert "PartitionFilters: [isnotnull(source" in year and "attrs:string" in year and "geom" not in year


def test_feature_lines(spark, fires, tmp_path):
    path = str(tmp_path / "lines")
    export.write_features(export.to_feature_rows(fires), path)
    back = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert len(back) == 6 and {f["type"] for f in back} == {"Feature"}
