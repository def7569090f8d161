"""Sync streams over landed polls: lifecycle, replay and failure behaviour."""

import datetime as dt
import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from test_feeds import area, cap, collection, info

from emberlake.operators import status
from emberlake.plans import streams
from emberlake.sources import snapshot
from emberlake.streaming import store, sync

UTC = dt.timezone.utc
START = dt.datetime(2026, 7, 1, tzinfo=UTC)


def when(n):
    return START + dt.timedelta(hours=n)


def land(spark, folder, n, layers, err=None):
    docs = None
    if layers is not None:
        rows = [(f"{layer}-{i}", layer, p) for layer, payloads in layers.items() for i, p in enumerate(payloads)]
        docs = spark.createDataFrame(rows, "doc_id string, layer string, payload string")
    sync.land_poll(docs, folder, f"poll-{n}", when(n), spark, err=err)


def log(spark, root):
    return {r["batch_id"]: (r["inserted"], r["updated"], r["closed"]) for r in sync.change_log(spark, root).collect()}


def ends(spark, root):
    rows = sync.events(spark, root).selectExpr("external_id", "cast(ends_at as string) e").collect()
    return {r["external_id"]: r["e"] for r in rows}


def text(n):
    return when(n).strftime("%Y-%m-%d %H:%M:%S")


def test_fires_close_reopen_and_survive_failures(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    none = collection()
    land(spark, landed, 0, {"hotspots": [none], "burnt_areas": [collection(area(), area(fire_id="502"))]})
    land(spark, landed, 1, {"hotspots": [none], "burnt_areas": [collection(area())]})
    land(spark, landed, 2, None, err="timeout" * 100)
    land(spark, landed, 3, {"hotspots": [none], "burnt_areas": [collection(area(fire_id=None))]})
    land(spark, landed, 4, {"hotspots": [none], "burnt_areas": [collection(area(), area(fire_id="502"))]})
    sync.sync_wildfires(spark, landed, root, most_runs=1, skip_refused=True)
    # One file holds everything that happened; the unreadable poll closed nothing.
    assert log(spark, root) == {0: (2, 0, 0), 1: (0, 0, 1), 4: (0, 1, 0)}
    assert ends(spark, root) == {"ba-501": None, "ba-502": None}
    polls = sync.poll_log(spark, root).collect()
    assert sorted((r["poll_id"], r["ok"]) for r in polls) == [
        ("poll-0", True), ("poll-1", True), ("poll-2", False), ("poll-4", True)
    ]
    state = status.sync_state(sync.poll_log(spark, root)).first()
    assert state["consecutive_failures"] == 0 and state["last_error"] is None

    # A later empty poll closes everything; the stream goes on from its checkpoint.
    land(spark, landed, 5, {"hotspots": [none], "burnt_areas": [none]})
    sync.sync_wildfires(spark, landed, root, most_runs=1)
    assert log(spark, root)[5] == (0, 0, 2)
    assert ends(spark, root) == {"ba-501": text(5), "ba-502": text(5)}
    assert snapshot.read_snapshot(spark, f"{root}/snapshot").where("ends_at is null").count() == 0

    # Replaying the last batch leaves the same result.
    marker = spark.read.schema(sync.MARKER).parquet(f"{landed}/markers").where("poll_id = 'poll-5'").first()
    assert sync.reconcile_poll(spark, marker, 5, root, "effis") == (0, 0, 2)
    assert log(spark, root)[5] == (0, 0, 2) and len(ends(spark, root)) == 2


def test_warning_lifecycle(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    x = cap(info("es-ES", "x"), "x", "Alert")
    y = cap(info("es-ES", "y"), "y", "Update", "http://a,x,2026-07-01T02:03:04-00:00")
    day = {"2026-07-03T12": "2026-07-01T12", "2026-07-03T21": "2026-07-01T21", "2026-07-02T10:05:30": "2026-07-01T01:30:00"}
    for old, new in day.items():
        x, y = x.replace(old, new), y.replace(old, new)
    land(spark, landed, 1, {"warnings": [x]})
    land(spark, landed, 2, {"warnings": [y]})
    land(spark, landed, 3, {"warnings": []})
    land(spark, landed, 4, {"warnings": [y]})
    land(spark, landed, 5, {"warnings": [x, y]})
    land(spark, landed, 6, {"warnings": [x, y]})
    sync.sync_warnings(spark, landed, root)
    got = log(spark, root)
    assert (got[0], got[1], got[2], got[3]) == ((1, 0, 0), (1, 0, 1), (0, 0, 1), (0, 1, 0))
    # A bulletin with a warning and its own successor reopens and closes it every time.
    assert got[4] == (0, 1, 1) and got[5] == (0, 1, 1)
    assert ends(spark, root) == {"x": "2026-07-01 01:30:00", "y": "2026-07-01 19:30:00"}


def test_store_reads_are_bounded_by_batch(spark, tmp_path):
    root = str(tmp_path)
    assert store.read_state(spark, root).count() == 0
    assert store.last_committed(spark, root) is None


@pytest.mark.parametrize("limit", [1])
def test_oversized_bulletin_is_refused(spark, tmp_path, limit):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    land(spark, landed, 1, {"warnings": [cap(info("es-ES", "x"), "x"), cap(info("es-ES", "y"), "y")]})
    with pytest.raises(StreamingQueryException):
        sync.sync_warnings(spark, landed, root, max_documents=limit)
    assert [r["reason"] for r in sync.refused_polls(spark, root).collect()] == ["the bulletin exceeds its limits"]
    assert log(spark, root) == {} and sync.poll_log(spark, root).count() == 0
    assert json.dumps(ends(spark, root)) == "{}"


def test_a_broken_document_or_layer_closes_nothing(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    none, one, two = collection(), collection(area()), collection(area(fire_id="502"))
    land(spark, landed, 0, {"hotspots": [none], "burnt_areas": [one, two]})
    land(spark, landed, 1, {"hotspots": [none], "burnt_areas": [one, two[:-9]]})
    land(spark, landed, 2, {"hotspots": [none]})
    land(spark, landed, 3, {"hotspots": [none], "burnt_areas": [one, two]})
    sync.sync_wildfires(spark, landed, root, skip_refused=True)
    assert log(spark, root) == {0: (2, 0, 0)} and set(ends(spark, root).values()) == {None}
    refused = {r["poll_id"]: r["reason"] for r in sync.refused_polls(spark, root).collect()}
    assert refused == {"poll-1": "a document cannot be read", "poll-2": "a layer has no document"}
    assert sorted(r["poll_id"] for r in sync.poll_log(spark, root).collect()) == ["poll-0", "poll-3"]


def test_an_older_poll_is_refused(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    land(spark, landed, 5, {"hotspots": [collection()], "burnt_areas": [collection(area())]})
    sync.sync_wildfires(spark, landed, root)
    land(spark, landed, 4, {"hotspots": [collection()], "burnt_areas": [collection()]})
    with pytest.raises(StreamingQueryException):
        sync.sync_wildfires(spark, landed, root)
    assert set(ends(spark, root).values()) == {None}


def test_readers_see_committed_batches_only(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    land(spark, landed, 0, {"hotspots": [collection()], "burnt_areas": [collection(area())]})
    sync.sync_wildfires(spark, landed, root)
    kept = store.load(spark, root)
    planted = store.read_runs(spark, root, kept, "events").withColumn("external_id", F.lit("planted"))
    store.write_events(planted, root, "batch=99", kept.buckets)
    store.write_folder(planted, root, "bulletin", "batch=99")
    assert set(ends(spark, root)) == {"ba-501"}
    assert store.read_table(spark, root, "bulletin").first()["external_id"] == "ba-501"
    # a manifest without the pointer to it is no commit either
    late = store.begin(spark, root, 99)
    late.add("events", "events/batch=99", {str(b): 1 for b in range(late.buckets)})
    store._write_text(spark, f"{root}/manifest/batch=99.json", json.dumps(store.asdict(late)))
    assert set(ends(spark, root)) == {"ba-501"} and store.last_committed(spark, root) == 0


def fires(n, **more):
    return collection(*[area(fire_id=str(i), **more) for i in range(n)])


def test_a_poll_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    land(spark, landed, 0, {"hotspots": [collection()], "burnt_areas": [fires(60)]})
    sync.sync_wildfires(spark, landed, root)
    manifest = store.load(spark, root)
    assert len(manifest.runs["events"]) > 10
    keys = spark.createDataFrame([("effis", "ba-7"), ("effis", "ba-none")], "source string, external_id string")
    state = store.read_state(spark, root, keys=keys)
    wanted = {f"bucket={r[0]}" for r in keys.select(store.bucket_of(manifest.buckets)).collect()}
    read = {part for f in state.inputFiles() for part in f.split("/") if part.startswith("bucket=")}
    assert read and read <= wanted and [r["external_id"] for r in state.collect()] == ["ba-7"]


def test_bytes_written_follow_the_poll(spark, tmp_path):
    """Eighteen polls that each revise one fire of sixty: merges rewrite small runs, and the first run stays."""
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    land(spark, landed, 0, {"hotspots": [collection()], "burnt_areas": [fires(60)]})
    sync.sync_wildfires(spark, landed, root, snapshot_every=0)
    state = store.read_state(spark, root).cache()
    written = 0
    for n in range(1, 19):
        manifest = store.begin(spark, root, n)
        row = state.where(F.col("external_id") == f"ba-{n % 3}").withColumn("severity", F.lit(1).cast("short"))
        row = row.withColumns({"action": F.lit("updated"), "batch": F.lit(n).cast("bigint"), "step": F.lit(0)})
        folder, sizes = store.write_events(row, root, f"batch={n}", manifest.buckets)
        manifest.add("events", folder, sizes)
        before = {f for b in manifest.runs["events"].values() for f, _ in b}
        store.merge_runs(spark, root, manifest, most=3)
        store.commit(spark, root, manifest)
        merged = [(f, k) for b in manifest.runs["events"].values() for f, k in b if f not in before]
        written += sum(k for _, k in merged) + 1
    runs = store.load(spark, root).runs["events"]
    assert all(len(r) <= 3 for r in runs.values()) and any(r[0][0] == "events/batch=0" for r in runs.values())
    assert written < 18 * 8
    got = {r["external_id"]: r["severity"] for r in store.read_state(spark, root).collect()}
    assert len(got) == 60 and {got[f"ba-{i}"] for i in range(3)} == {1} and got["ba-5"] != 1
    assert store.expire(spark, root, keep=1) > 10
    assert store.read_state(spark, root).count() == 60


def test_merge_keeps_sizes_apart():
    assert store.merge_from([["a", 9], ["b", 1]], 2) is None
    assert store.merge_from([["a", 1000], ["b", 10], ["c", 1], ["d", 1]], 3) == 2
    assert store.merge_from([["a", 1000], ["b", 3], ["c", 1], ["d", 1]], 3) == 1
    assert store.merge_from([["a", 1], ["b", 1], ["c", 1]], 2) == 0
    assert store.merge_from([["a", 10**6], ["b", 10**4], ["c", 100], ["d", 1]], 2) == 1


def test_sync_state_is_the_fold_of_the_log(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    none = collection()
    for n, layers in enumerate([None, {"hotspots": [none], "burnt_areas": [collection(area())]}, None, None]):
        land(spark, landed, n, layers, err="timeout" if layers is None else None)
        sync.sync_wildfires(spark, landed, root, most_runs=2)
        assert sync.sync_state(spark, root).collect() == status.sync_state(sync.poll_log(spark, root)).collect()
    assert sync.sync_state(spark, root).first()["consecutive_failures"] == 2
    assert len(store.load(spark, root).runs["poll_log"]["0"]) <= 2 and sync.poll_log(spark, root).count() == 4


def test_a_one_event_poll_rewrites_one_year_of_the_snapshot(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    dated = [area(fire_id=str(y), initialdate=f"{y}-03-01 00:00:00") for y in range(2015, 2025)]
    land(spark, landed, 0, {"hotspots": [collection()], "burnt_areas": [collection(*dated)]})
    dated[4] = area(fire_id="2019", initialdate="2021-03-02 00:00:00")
    land(spark, landed, 1, {"hotspots": [collection()], "burnt_areas": [collection(*dated)]})
    sync.sync_wildfires(spark, landed, root)
    folder = f"{root}/snapshot"
    assert snapshot.versions(spark, folder) == [0, 1]
    first, second = ({r["path"] for r in snapshot.files_of(spark, folder, v).collect()} for v in (0, 1))
    assert len(first) == 10 and {p.split("/")[2] for p in second - first} == {"year=2021"}
    assert {p.split("/")[2] for p in first - second} == {"year=2019", "year=2021"}
    rows = {r["external_id"]: r["y"] for r in snapshot.read_snapshot(spark, folder).selectExpr("external_id", "year(starts_at) y").collect()}
    assert len(rows) == 10 and rows["ba-2019"] == 2021 and rows["ba-2021"] == 2021
    old = {r["external_id"]: r["y"] for r in snapshot.read_snapshot(spark, folder, version=0).selectExpr("external_id", "year(starts_at) y").collect()}
    assert old["ba-2019"] == 2019
    assert snapshot.expire(spark, folder, keep=1) == 2 and snapshot.read_snapshot(spark, folder).count() == 10


def test_snapshot_follows_later_changes(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    for n, fires in enumerate([[area()], [area(), area(fire_id="502")], [area(), area(fire_id="502")]]):
        land(spark, landed, n, {"hotspots": [collection()], "burnt_areas": [collection(*fires)]})
    sync.sync_wildfires(spark, landed, root, snapshot_every=2)
    # the change of batch 1 is in the snapshot of batch 2, which changed nothing itself
    assert snapshot.versions(spark, f"{root}/snapshot") == [0, 2]
    assert snapshot.read_snapshot(spark, f"{root}/snapshot").count() == 2


def noted(monkeypatch):
    """Columns of every table a poll writes between its steps, by label."""
    seen = {}
    write = sync.materialised

    def record(df, label="step"):
        seen.setdefault(label, []).append(df.columns)
        return write(df, label)

    monkeypatch.setattr(sync, "materialised", record)
    return seen


def quakes(*found):
    items = "".join(
        f"<item><description>terremoto de magnitud {m} en MAR en la fecha 01/02/2026 12:00:00 en</description>"
        f"<guid>http://www.example.org/x?evid={i}</guid><geo:lat>40</geo:lat><geo:long>-3</geo:long></item>"
        for i, m in found
    )
    return f'<rss xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#"><channel>{items}</channel></rss>'


def test_a_quake_poll_moves_no_more_columns_than_it_compares(spark, tmp_path, monkeypatch):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    seen = noted(monkeypatch)
    land(spark, landed, 0, {"quakes": [quakes(("es1", 2.1), ("es2", 2.2)), quakes(("es1", 2.4))]})
    land(spark, landed, 1, {"quakes": [quakes(("es1", 2.4), ("es2", 3.0), ("es3", 1.5))]})
    sync.sync_quakes(spark, landed, root)
    assert log(spark, root) == {0: (2, 0, 0), 1: (1, 1, 0)}
    assert all("geom" not in c and "attrs" not in c for c in seen["state"]) and not {"poll", "changes", "changed"} & set(seen)
    rows = store.read_state(spark, root, columns=["attrs"])
    assert rows.columns == ["source", "external_id", "attrs"]
    assert {r["external_id"]: json.loads(r["attrs"])["magnitude"] for r in rows.collect()} == {"es1": 2.4, "es2": 3.0, "es3": 1.5}
    whole = {r["external_id"]: r["severity"] for r in sync.events(spark, root).collect()}
    kept = {r["external_id"]: r["severity"] for r in snapshot.read_snapshot(spark, f"{root}/snapshot").collect()}
    assert whole == kept and len(whole) == 3


def test_a_fire_poll_writes_its_state_and_changes_once(spark, tmp_path, monkeypatch):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    none = collection()
    land(spark, landed, 0, {"hotspots": [none], "burnt_areas": [collection(area(area="10"), area(fire_id="502")), collection(area(area="20"))]})
    land(spark, landed, 1, {"hotspots": [none], "burnt_areas": [collection(area(area="20"))]})
    land(spark, landed, 2, {"hotspots": [none], "burnt_areas": [collection(area(area="30"), area(fire_id="502"))]})
    seen = noted(monkeypatch)
    sync.sync_wildfires(spark, landed, root)
    assert log(spark, root) == {0: (2, 0, 0), 1: (0, 0, 1), 2: (0, 2, 0)}
    assert len(seen["state"]) == 3 and not {"poll", "changes"} & set(seen)
    got = {r["external_id"]: json.loads(r["attrs"])["area_ha"] for r in sync.events(spark, root).collect()}
    assert got["ba-501"] == 30.0 and set(got) == {"ba-501", "ba-502"}
    assert set(ends(spark, root).values()) == {None}


def test_a_run_of_two_steps_reaches_the_snapshot_by_its_last(spark, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "store")
    x, y = cap(info("es-ES", "x"), "x"), cap(info("es-ES", "y"), "y", "Update", "http://a,x,2026-07-01T02:03:04-00:00")
    land(spark, landed, 0, {"warnings": [x, y]})
    sync.sync_warnings(spark, landed, root)
    assert log(spark, root)[0] == (2, 0, 1)
    rows = snapshot.read_snapshot(spark, f"{root}/snapshot").selectExpr("external_id", "cast(ends_at as string) e").collect()
    assert len(rows) == 2 and {r["external_id"]: r["e"] for r in rows} == ends(spark, root)


def test_messages_and_reports_are_rendered_by_many_tasks(spark, sf_dir):
    for documents in (streams._warning_documents, streams._fire_documents, streams._quake_documents):
        plan = documents(spark, sf_dir, 0)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan and plan.count("Exchange") == 1
