import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import brute_dbscan, event, events_frame, point, square
from oracle import compare, connect

import __spark_entry__ as entry
from emberlake.operators import checks, clusters, components, grid

IBERIA = (-9.5, 36.0, 3.4, 43.8)


def madrid(spark):
    return events_frame(
        spark,
        [
            event("m0", point(-3.70, 40.42)),
            event("m1", point(-3.75, 40.42), severity=3, hours=1),
            event("m2", point(-3.70, 40.46), hours=2),
            event("q", point(-3.71, 40.43), hazard_type="earthquake", source="ign", hours=3),
            event("toledo", point(-4.02, 39.86), hours=4),
            event("bcn", point(2.15, 41.39), hours=5),
        ],
    )


def test_trio_is_one_cluster_and_noise_is_left_out(spark):
    rows = clusters.cluster_summary(
        madrid(spark), eps_m=5000, min_points=3, bbox=IBERIA, hazard_types=["wildfire"]
    ).collect()
    assert len(rows) == 1
    assert (rows[0]["count"], rows[0]["max_severity"], rows[0]["cluster_id"]) == (3, 3, 0)
    assert abs(rows[0]["lon"] + 3.7166) < 0.001 and abs(rows[0]["lat"] - 40.4333) < 0.001


def test_all_types_join_and_high_minimum_finds_none(spark):
    got = clusters.cluster_summary(madrid(spark), eps_m=5000, min_points=3, bbox=IBERIA).collect()
    assert [r["count"] for r in got] == [4]
    assert clusters.dbscan_labels(madrid(spark), eps_m=5000, min_points=6, bbox=IBERIA).count() == 0


def test_bounding_filter_and_ranges_are_required(spark):
    df = madrid(spark)
    with pytest.raises(ValueError):
        clusters.dbscan_labels(df, eps_m=5000, min_points=3)
    with pytest.raises(ValueError):
        clusters.dbscan_labels(df, eps_m=0, min_points=3, bbox=IBERIA)
    with pytest.raises(ValueError):
        clusters.dbscan_labels(df, eps_m=5000, min_points=0, bbox=IBERIA)


def _scatter(seed, n_points, n_shapes):
    rnd = random.Random(seed)
    rows = []
    for i in range(n_points):
        cx, cy = rnd.choice([(-3.7, 40.4), (-3.6, 40.45), (-3.5, 40.3), (-4.0, 40.1)])
        spread = rnd.choice([0.002, 0.02, 0.08])
        lon, lat = cx + rnd.gauss(0, spread), cy + rnd.gauss(0, spread)
        if i % 7 == 0:  # repeated places
            lon, lat = round(lon, 2), round(lat, 2)
        rows.append(event(f"p{i}", point(lon, lat)))
    for i in range(n_shapes):
        lon, lat = -3.8 + rnd.random() * 0.5, 40.2 + rnd.random() * 0.4
        if i % 5 == 0:
            lon, lat = -3.71, 40.41
        rows.append(event(f"s{i}", square(lon, lat, rnd.choice([0.001, 0.01, 0.03]))))
    return rows


@pytest.mark.parametrize(
    ("seed", "n_points", "n_shapes", "eps", "min_points", "short"),
    [
        (2, 120, 20, 1200, 5, 64),
        (3, 150, 10, 2500, 12, 1),
        (4, 300, 0, 4000, 25, 2),
    ],
)
def test_labels_agree_with_brute_force(spark, monkeypatch, seed, n_points, n_shapes, eps, min_points, short):
    # A tiny list length drives the box refinement through several levels.
    monkeypatch.setattr(clusters, "SHORT", short)
    df = events_frame(spark, _scatter(seed, n_points, n_shapes)).cache()
    items = [(r["id"], r["geom"]) for r in df.select("id", "geom").collect()]
    want = brute_dbscan(items, eps, min_points)
    got = {
        r["id"]: r["cluster"]
        for r in clusters.dbscan_labels(df, eps_m=eps, min_points=min_points, bbox=IBERIA).collect()
    }
    assert got == want
    assert len(set(want.values())) > 1 or n_shapes


def test_labels_hold_when_every_join_is_salted(spark, monkeypatch):
    monkeypatch.setattr(grid, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(grid, "CROWDED_ROWS", 3)
    monkeypatch.setattr(clusters, "SHORT", 4)
    df = events_frame(spark, _scatter(5, 120, 8)).cache()
    items = [(r["id"], r["geom"]) for r in df.select("id", "geom").collect()]
    got = clusters.dbscan_labels(df, eps_m=1800, min_points=5, bbox=IBERIA).collect()
    assert {r["id"]: r["cluster"] for r in got} == brute_dbscan(items, 1800, 5)
    assert len(got) == len({r["id"] for r in got})


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("s000", f"s{i:03d}") for i in range(1, 80)]
    got = components.components(spark.createDataFrame(chain + star, "u string, v string")).collect()
    labels = {r["node"]: r["label"] for r in got}
    assert len(got) == len(labels) == 61 + 80
    assert {labels[n] for n in labels if n[0] == "c"} == {"c000"}
    assert {labels[n] for n in labels if n[0] == "s"} == {"s000"}


def _stack(n):
    """Outlines over the same ground that differ by a fraction of a millimetre."""
    return [event(f"o{i:02d}", square(-3.7, 40.4, 0.02 + i * 1e-9)) for i in range(n)]


def _links_of(spark, rows):
    shapes = clusters._shape_sites(events_frame(spark, rows)).cache()
    none = spark.createDataFrame([], "kx long, ky long")
    covered = clusters._Outlines(shapes, none, 700.0).cover.cache()
    return covered, clusters._cover_links(covered).collect()


def test_edges_between_cells_do_not_grow_with_the_outlines_over_them(spark):
    covered, one = _links_of(spark, _stack(1))
    cells = covered.select("cx", "cy").distinct().count()
    assert covered.count() == cells == len(one) + 1
    many_covered, many = _links_of(spark, _stack(12))
    assert many_covered.count() == 12 * cells
    assert set(many) == set(one) and len(many) == len(one)


def test_cells_of_an_outline_are_one_piece_even_with_gaps(spark):
    rows = [(1, 0, 0), (1, 7, 0), (1, 3, 5), (1, 4, 5), (1, -2, 9), (2, 100, 0), (2, 100, 1)]
    covered = spark.createDataFrame([(n, 1, x, y) for n, x, y in rows], "num long, w long, cx long, cy long")
    labels = {r["node"]: r["label"] for r in components.components(clusters._cover_links(covered)).collect()}
    nodes = covered.select("num", clusters._cell_node(covered["cx"], covered["cy"]).alias("node")).collect()
    assert len(labels) == len(rows)
    for n in (1, 2):
        assert {labels[r["node"]] for r in nodes if r["num"] == n} == {min(r["node"] for r in nodes if r["num"] == n)}


def test_outlines_are_sorted_by_their_hash_and_equal_ones_are_one_site(spark):
    rows = [event("a", square(0.0, 40.4, 0.01)), event("b", square(-0.0, 40.4, 0.01)), event("c", square(0.0, 40.4, 0.02))]
    sites = clusters._shape_sites(events_frame(spark, rows))
    plan = sites._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_hash" in plan
    assert sorted(r["w"] for r in sites.collect()) == [1, 2]


def test_features_hold_early_and_undated_events(spark, tmp_path):
    early, late = dt.datetime(1987, 5, 4), dt.datetime(1999, 3, 2)
    # equal remainders put quakes (1), burnt areas (3) and warnings (2) of a customer on one place
    step = 120 * 101 * 97
    mixed = [(1 + i * step, 3, day) for i, day in enumerate([early, None, late, None, early, late])]
    areas = [(3 + i * step, 13, day) for i, day in enumerate([early, None, None, late])]
    undated = [(7 + i * step, 17, None) for i in range(5)]
    warnings = [(2 + i * step, 29, day) for i, day in enumerate([early, early, None, early, None, late, early])]
    keys, customers, days = zip(*mixed, *areas, *undated, *warnings)
    orders = pa.table(
        {"o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array(customers, pa.int64()),
         "o_orderdate": pa.array(days, pa.timestamp("us"))}
    )
    pq.write_table(orders, tmp_path / "orders.parquet")
    found = entry.queries()["cluster_features"](spark, str(tmp_path)).orderBy("cluster_id").collect()
    first = [r["first_starts_at"] and r["first_starts_at"][:4] for r in found]
    assert [r["count"] for r in found] == [7, 6, 5, 4] and first == ["1987", "1987", None, "1987"]
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), "cluster_features") is None


def test_unbounded_clusters_must_be_allowed(spark):
    frame = events_frame(spark, [event(f"e{i}", point(-3.7, 40.4)) for i in range(3)])
    with checks.overridden(unbounded_clusters=True):
        got = clusters.dbscan_labels(frame, eps_m=500, min_points=3)
    assert got.count() == 3
    with pytest.raises(ValueError):
        clusters.dbscan_labels(frame, eps_m=500, min_points=3)
