"""Feed readers on well-formed and malformed documents."""

import json

import pytest
from pyspark.sql import functions as F

from emberlake.sources import feeds

ITEM = (
    "<item><title>t</title><guid>http://www.example.org/x?evid=es2025tq7</guid>"
    "<description>Se ha producido un terremoto de magnitud 3.2 en SIERRA DE PRUEBA en la fecha "
    "14/03/2025 9:41:05 en la siguiente localización: 38.2514,-6.4127</description>"
    "<geo:lat>38.2514</geo:lat><geo:long>-6.4127</geo:long></item>"
)


def rss(items):
    return (
        '<?xml version="1.0" encoding="UTF-8"?><rss xmlns:geo="http://www.w3.org/2003/01/geo/wgs84_pos#" '
        f'version="2.0"><channel>{items}</channel></rss>'
    )


def documents(spark, payloads):
    rows = [(f"p{i}", "d", p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "poll_id string, doc_id string, payload string")


def verdicts(gate):
    return {r["poll_id"]: (r["units"], r["good"], r["verdict"]) for r in gate.collect()}


def test_quake_item(spark):
    good, _, _ = feeds.split_malformed(feeds.ingest_quakes(documents(spark, [rss(ITEM)])))
    r = good.select("*", F.col("occurred_at").cast("string").alias("t")).first()
    assert (r["external_id"], r["magnitude"], r["region"]) == ("es2025tq7", 3.2, "SIERRA DE PRUEBA")
    assert (r["latitude"], r["longitude"], r["t"]) == (38.2514, -6.4127, "2025-03-14 08:41:05")
    assert r["raw_local_moment"] == "14/03/2025 9:41:05"
    row = feeds.quake_events(good).first()
    assert json.loads(row["attrs"]) == {
        "raw_local_moment": "14/03/2025 9:41:05", "magnitude": 3.2, "region": "SIERRA DE PRUEBA"
    }
    assert row["severity"] == 2 and row["starts_at"] == row["ends_at"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("aviso: magnitud revisada. terremoto de magnitud 3.2 en A en la fecha 14/03/2025 9:41:05 en", ("3.2", "A")),
        ("magnitud\n3.2 en A en la fecha 14/03/2025 9:41:05", ("3.2", "A")),
        ("magnitud 3 en A en la fecha\n14/03/2025\t09:41:05.", ("3", "A")),
        ("magnitud 3.2 en  GOLFO  DE en  la\u00a0en la fecha 14/03/2025 9:41:05", ("3.2", "GOLFO  DE en  la")),
        ("magnitud 2.1 en A en la fecha de ayer en la fecha 14/03/2025 9:41:05", ("2.1", "A en la fecha de ayer")),
        ("magnitud 9 en A en la fecha. magnitud 1.5 en B en la fecha 14/03/2025 9:41:05", ("9", "A en la fecha. magnitud 1.5 en B")),
        ("magnitud 1.2.3 en A en la fecha 14/03/2025 9:41:05", None),
        ("magnitud . en A en la fecha 14/03/2025 9:41:05", None),
        ("magnitud 3.2 en A en la fecha 14/03/2025 9:41", None),
        ("magnitud 3.2 en en la fecha 14/03/2025 9:41:05", None),
        ("", None),
    ],
)
def test_quake_wordings(spark, text, want):
    item = ITEM.replace(ITEM.split("<description>")[1].split("</description>")[0], text)
    rows = feeds.ingest_quakes(documents(spark, [rss(item)])).select(
        "parse_ok", "magnitude", "region", F.col("occurred_at").cast("string").alias("t"), "raw_local_moment"
    ).collect()
    assert [r["parse_ok"] for r in rows] == [want is not None]
    if want:
        r = rows[0]
        assert (r["magnitude"], r["region"]) == (float(want[0]), want[1])
        assert r["t"] == "2025-03-14 08:41:05" and r["raw_local_moment"].split(" ")[0] == "14/03/2025"


def test_malformed_quake_items_are_skipped_and_bad_feeds_told_apart(spark):
    bad = [
        ITEM.replace("?evid=es2025tq7", ""),
        ITEM.replace("<geo:lat>38.2514", "<geo:lat>98.2514"),
        ITEM.replace("<geo:long>-6.4127", "<geo:long>nan"),
        ITEM.replace("<geo:long>-6.4127", "<geo:long>1e999"),
        ITEM.replace("magnitud 3.2", "magnitud -3.2"),
        ITEM.replace("14/03/2025 9:41:05 en", "42/07/2026 7:06:37 en"),
    ]
    payloads = [rss(ITEM + b) for b in bad] + [rss(bad[0]), rss(""), "no markup here", rss(ITEM)[:-30]]
    good, quarantine, gate = feeds.split_malformed(feeds.ingest_quakes(documents(spark, payloads)))
    got = verdicts(gate)
    for i in range(len(bad)):
        assert got[f"p{i}"] == (2, 1, "ok")
    assert got["p6"] == (1, 0, "failed") and got["p7"] == (0, 0, "empty")
    assert got["p8"] == (1, 0, "failed") and got["p9"] == (1, 0, "failed")
    assert good.count() == len(bad) and quarantine.count() == len(bad) + 3


def test_guid_falls_back_to_the_link(spark):
    item = ITEM.replace("<guid>http://www.example.org/x?evid=es2025tq7</guid>",
                        "<link>http://www.example.org/x?evid=es9</link>")
    assert feeds.ingest_quakes(documents(spark, [rss(item)])).first()["external_id"] == "es9"


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def area(geometry=None, **props):
    base = {"id": "9", "fire_id": "501", "initialdate": "2025-08-11 06:30:00",
            "finaldate": "2025-08-12 18:45:00", "area": "52"}
    base.update(props)
    base = {k: v for k, v in base.items() if v is not None}
    ring = [[39.2, -2.5], [39.3, -2.5], [39.25, -2.3], [39.2, -2.5]]
    return {"type": "Feature", "properties": base,
            "geometry": geometry or {"type": "Polygon", "coordinates": [ring]}}


def test_burnt_area(spark):
    multi = {"type": "MultiPolygon", "coordinates": [area()["geometry"]["coordinates"]] * 2}
    docs = documents(spark, [collection(area(), area(multi, fire_id="502", area=12.5))])
    good, _, _ = feeds.split_malformed(feeds.ingest_burnt_areas(docs))
    a, b = good.orderBy("external_id").collect()
    assert (a["external_id"], a["area_ha"], a["geom"]["kind"]) == ("ba-501", 52.0, "Polygon")
    assert tuple(a["geom"]["parts"][0][0][0]) == (-2.5, 39.2)
    assert (b["external_id"], b["area_ha"], len(b["geom"]["parts"])) == ("ba-502", 12.5, 2)
    attrs = json.loads(a["attrs"])
    assert attrs["kind"] == "burnt_area" and attrs["raw_finaldate"] == "2025-08-12 18:45:00"


def test_malformed_burnt_areas(spark):
    ring = area()["geometry"]["coordinates"][0]
    bad = [
        area(fire_id=None),
        area({"type": "LineString", "coordinates": ring}),
        area({"type": "Polygon", "coordinates": []}),
        area({"type": "Polygon", "coordinates": [[]]}),
        area({"type": "Polygon", "coordinates": [[[142.0, -4.0], *ring[1:]]]}),
        area({"type": "Polygon", "coordinates": [["x", *ring[1:]]]}),
        area(area="nan"),
        area(area="1e999"),
        area(area="-1"),
        area(initialdate="2025-13-11 06:30:00"),
        {"type": "Feature", "properties": "none", "geometry": None},
    ]
    payloads = [collection(area(), b) for b in bad]
    payloads += [collection(bad[0]), collection(), "<p>closed today</p>", '{"type":"x"}']
    good, _, gate = feeds.split_malformed(feeds.ingest_burnt_areas(documents(spark, payloads)))
    got = verdicts(gate)
    for i in range(len(bad)):
        assert got[f"p{i}"] == (2, 1, "ok"), bad[i]
    n = len(bad)
    assert [got[f"p{n + i}"][2] for i in range(4)] == ["failed", "empty", "failed", "failed"]
    assert {r["external_id"] for r in good.collect()} == {"ba-501"}


def test_hotspot(spark):
    spot = {"type": "Feature", "properties": {"id": "31", "acq_at": "2025-05-04 03:15:00", "CLASS": "OWN_CLASS"},
            "geometry": {"type": "Point", "coordinates": [40.125, 2.75]}}
    good, _, _ = feeds.split_malformed(feeds.ingest_hotspots(documents(spark, [collection(spot, area())])))
    r = good.select("*", F.col("observed_at").cast("string").alias("t")).collect()
    assert len(r) == 1 and r[0]["external_id"] == "hs-31" and r[0]["t"] == "2025-05-04 03:15:00"
    assert (r[0]["geom"]["minx"], r[0]["geom"]["miny"]) == (2.75, 40.125)
    events = feeds.fire_events(good, good.limit(0)).first()
    assert events["severity"] == 2 and events["starts_at"] == events["ends_at"]


def info(language, event, level="naranja"):
    return (
        f"<info><language>{language}</language><event>{event}</event><severity>Severe</severity>"
        "<eventCode><valueName>AEMET-Meteoalerta fenomeno</valueName><value>XX;Fenómeno inventado</value></eventCode>"
        "<onset>2026-07-03T12:00:00+02:00</onset><expires>2026-07-03T21:30:00+02:00</expires>"
        "<headline>h</headline><description>d</description>"
        f"<parameter><valueName>AEMET-Meteoalerta nivel</valueName><value>{level}</value></parameter>"
        "<parameter><valueName>AEMET-Meteoalerta probabilidad</valueName><value>5%-15%</value></parameter>"
        "<area><areaDesc>Zona inventada</areaDesc>"
        "<polygon>41.0,-2.0 41.5,-2.0 41.5,-1.5 41.0,-2.0</polygon>"
        "<geocode><valueName>AEMET-Meteoalerta zona</valueName><value>123456</value></geocode></area></info>"
    )


def cap(body, identifier="w1", kind="Update", references=None):
    refs = f"<references>{references}</references>" if references else ""
    ident = f"<identifier>{identifier}</identifier>" if identifier else ""
    return (
        f'<?xml version="1.0" encoding="UTF-8"?><alert xmlns="urn:oasis:names:tc:emergency:cap:1.2">{ident}'
        f"<sent>2026-07-02T10:05:30-00:00</sent><msgType>{kind}</msgType>{refs}{body}</alert>"
    )


def test_warning(spark):
    text = cap(
        info("en-GB", "Heat") + info("es-ES", "Aviso inventado"),
        references="http://a,old-1,2026-07-01T02:03:04-00:00 junk http://a,old-2,2026-07-01T05:06:07-00:00",
    )
    good, _, _ = feeds.split_malformed(feeds.ingest_warnings(documents(spark, [text])))
    r = good.select(
        "*", F.col("onset").cast("string").alias("o"), F.col("sent").cast("string").alias("s")
    ).first()
    assert (r["external_id"], r["msg_type"], r["references"]) == ("w1", "Update", ["old-1", "old-2"])
    assert (r["event"], r["level"], r["zone"]) == ("Aviso inventado", "naranja", "123456")
    assert (r["phenomenon"], r["o"], r["s"]) == (
        "XX;Fenómeno inventado", "2026-07-03 10:00:00", "2026-07-02 10:05:30"
    )
    rows, refused = feeds.warning_events(good)
    row = rows.first()
    assert row["severity"] == 3 and refused.count() == 0
    attrs = json.loads(row["attrs"])
    assert attrs["probability"] == "5%-15%" and attrs["cap_severity"] == "Severe" and "parameter" not in attrs


def test_cancel_and_malformed_warnings(spark):
    payloads = [
        cap("", "c1", "Cancel", "http://a,old-1,2026-07-01T02:03:04-00:00"),
        cap(info("es-ES", "x"), identifier=None),
        "no markup here",
        cap(info("es-ES", "x").replace("2026-07-03T12:00:00+02:00", "soon")),
        cap(info("es-ES", "x", level="morado"), "odd"),
        cap(info("es-ES", "x", level="verde"), "green"),
        cap(info("es-ES", "x").replace("41.0,-2.0 41.5,-2.0", "41.0 41.5"), "shape"),
    ]
    records = feeds.ingest_warnings(documents(spark, payloads))
    good, bad, _ = feeds.split_malformed(records)
    assert sorted(r["external_id"] for r in good.collect()) == ["c1", "green", "odd", "shape"]
    assert bad.count() == 3
    cancel = good.where("external_id = 'c1'").first()
    assert cancel["references"] == ["old-1"] and cancel["level"] is None and cancel["polygon"] is None
    rows, refused = feeds.warning_events(good)
    assert rows.count() == 0
    assert sorted(r["external_id"] for r in refused.collect()) == ["odd", "shape"]


def test_bulletin_guard(spark):
    docs = spark.createDataFrame(
        [("many", "a", "x"), ("many", "b", "x"), ("many", "c", "x"), ("big", "a", "é" * 6), ("fine", "a", "x" * 10)],
        "poll_id string, doc_id string, payload string",
    )
    kept, refused = feeds.bulletin_guard(docs, max_documents=2, max_bytes=10)
    assert [r["poll_id"] for r in kept.collect()] == ["fine"]
    assert {r["poll_id"]: r["reason"] for r in refused.collect()} == {
        "many": "too many documents", "big": "document too large"
    }
