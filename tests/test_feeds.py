import html
import json
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from signalloom.functions import text
from signalloom.sources import feeds

NOW = "2024-02-01 12:00:00"


def frame(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "payload string")


def collection(*items):
    return {"type": "FeatureCollection", "features": list(items)}


def test_satellite(spark):
    table = "latitude,longitude,bright_ti4,acq_date,acq_time,satellite,instrument,confidence\n-33.1,-71.5,330,2024-01-31,24,N,VIIRS,n\n-33.2,-71.4,330,2024-01-31,1830,N,VIIRS,78\n-33.2,-71.4,330,2024-01-31,9999,N,VIIRS,h\n,,330,2024-01-31,10,N,VIIRS,h\n"
    rows = feeds.satellite(frame(spark, table), "VIIRS").orderBy("ts").collect()
    assert [(r["ts"].hour, r["ts"].minute, round(r["confidence"], 2)) for r in rows] == [(0, 24, 0.55), (18, 30, 0.78)]
    assert len({r["external_id"] for r in rows}) == 2 and all(r["external_id"].startswith("firms:") and len(r["external_id"]) == 38 for r in rows)
    assert feeds.satellite(frame(spark, table.split("\n")[0], ""), "VIIRS").collect() == []
    with pytest.raises(PySparkException, match="no satellite table"):
        feeds.satellite(frame(spark, "Invalid key."), "VIIRS").collect()


def test_wildfires(spark):
    point = lambda x, y: {"type": "Point", "coordinates": [x, y]}
    items = collection(
        {"id": 1, "geometry": point(-71.5, -33.1), "properties": {"id": 9, "nombre": "A", "estado": "En combate", "f_inicio": 1706700000000, "comuna": "Limache", "region": "Valparaíso"}},
        {"id": 2, "geometry": point(-33.2, -71.4), "properties": {"nombre": "B", "f_control": "31-01-2024 10:30", "region": "Región de Valparaíso"}},
        {"id": 3, "geometry": point(-73.0, -37.0), "properties": {"nombre": "C", "f_inicio": 1706700000000, "region": "Biobío"}},
        {"id": 4, "geometry": None, "properties": {"nombre": "D", "f_inicio": 1706700000000, "lat": "-33.0", "lon": "-71.0"}},
        {"id": 5, "geometry": point(-71.5, -33.1), "properties": {"nombre": "E", "region": "Valparaíso"}},
        None,
    )
    rows = {r["external_id"]: r for r in feeds.wildfires(frame(spark, items)).collect()}
    assert set(rows) == {"conaf:9", "conaf:2", "conaf:4"}
    assert (rows["conaf:2"]["lat"], rows["conaf:2"]["lon"], rows["conaf:2"]["ts"]) == (-33.2, -71.4, datetime(2024, 1, 31, 10, 30))
    assert 'Incendio forestal "A" — estado: En combate.' == rows["conaf:9"]["text"] and rows["conaf:4"]["lat"] == -33.0
    for bad in ({"error": {"code": 400}}, {"x": 1}, "<html>"):
        with pytest.raises(PySparkException, match="no feature collection"):
            feeds.wildfires(frame(spark, bad)).collect()
    assert feeds.wildfires(frame(spark, collection())).collect() == []


def test_shapes_give_the_middle_of_their_box(spark):
    shape = {"id": 1, "geometry": {"type": "Polygon", "coordinates": [[[-72, -34], [-70, -34], [-70, -32], [-72, -34]]]}, "properties": {}}
    r = feeds.features(frame(spark, collection(shape))).first()
    assert (r["lat"], r["lon"]) == (-33.0, -71.0)


def test_alert_layer(spark):
    make = lambda **p: {"geometry": None, "properties": {"Fecha": None, "Actualizado": 1706700000000, **p}}
    items = collection(
        make(Region="Valparaíso", Alerta="Alerta Roja", Evento="Incendio forestal", Comunas="Quilpué"),
        make(Region="Valparaíso", Alerta="Alerta Roja", Razon="Se ordena evacuación", Comunas="Quilpué, Limache"),
        make(Region="Maule", Alerta="Alerta Verde", Comunas="Talca"),
        make(Region="Maule", Ambito="Nacional", Alerta="Alerta Verde"),
    )
    rows = feeds.alert_layer(frame(spark, items)).collect()
    assert sorted(r["type"] for r in rows) == ["alert", "alert", "evacuation"] and all(r["lat"] is None and r["ts"] for r in rows)
    assert feeds.alert_layer(frame(spark, items), national=False).count() == 2


def test_quakes(spark):
    make = lambda i, x, y, mag, kind="earthquake": {"id": i, "geometry": {"type": "Point", "coordinates": [x, y, 33.5]}, "properties": {"mag": mag, "type": kind, "time": 1706700000000, "place": "p", "tsunami": 1, "status": "reviewed"}}
    items = {"metadata": {"status": 200}, "features": [make("a", -71.5, -33.0, 4.2), make("b", -71.5, -33.0, None), make("c", -60.0, -33.0, 5.0), make("d", -71.5, -33.0, 1.0), make("e", -71.5, -33.0, 5.0, "explosion"), {**make("f", -71.5, -33.0, 5.0), "geometry": None}, {**make(None, -71.5, -33.0, 5.0)}]}
    rows = {r["external_id"]: r for r in feeds.quakes(frame(spark, items)).collect()}
    assert set(rows) == {"usgs:a", "usgs:b"} and json.loads(rows["usgs:a"]["raw"])["depth_km"] == 33.5
    assert rows["usgs:b"]["text"] == "Sismo de magnitud no determinada"
    with pytest.raises(PySparkException):
        feeds.quakes(frame(spark, {**items, "metadata": {"status": 503}})).collect()


def test_unreadable_features_are_counted_in_the_same_pass(spark):
    good = {"id": "a", "geometry": {"type": "Point", "coordinates": [-71.5, -33.0]}, "properties": {"mag": 4.0, "type": "earthquake", "time": 1706700000000}}
    seen = Observation()
    items = collection(good, None, {**good, "id": " "}, {**good, "geometry": None}, {**good, "id": "b", "geometry": {"type": "Point", "coordinates": ["x", 1]}})
    assert [r["external_id"] for r in feeds.quakes(frame(spark, items), seen=seen).collect()] == ["usgs:a"]
    assert seen.get == {"features": 5, "unreadable": 4}


def test_keys_that_differ_in_case_only(spark):
    df = spark.createDataFrame([({"Region": " ", "region": "x", "REGION": "y"},)], "p map<string,string>")
    assert df.select(feeds.alias(F.col("p"), "none", "Region")).first()[0] == "x"


def test_quake_table(spark):
    row = lambda i, local, utc, spot, depth, mag: f'<tr><td><a href="/x/{i}.html">{local}</a><br/>30 km al O</td><td>{utc}</td><td>{spot}</td><td>{depth}</td><td>{mag}</td></tr>'
    near, winter = "-33.07 -71.6", "2024-06-30 23:10:41"
    rows = [
        row(1, "2024-01-30 23:10:41", "2024-01-31 02:10:41", near, "33.5 km", "4 Mww"),
        row(1, "2024-01-30 23:10:41", "2024-01-31 02:10:41", near, "33 km", "9.1 Ml"),
        row(2, winter, "", near, "900 km", "3.0"),
        row(3, winter, "", "-20.0 -69.0", "90 km", "5.0 Mw"),
        row(4, winter, "", near, "-1 km", "41 Ml"),
        row("q5", winter, "", near, "9 km", "4.1 Ml"),
        row(6, "later", "soon", near, "9 km", "4.1 Ml"),
        row(7, winter, "", "71.6", "9 km", "4.1 Ml"),
        "<tr><td>short</td></tr>",
    ]
    page = "<table><tr><th>h</th></tr>" + "".join(rows) + "</table>"
    got = {r["external_id"]: (r["ts"], json.loads(r["raw"])) for r in feeds.quake_table(frame(spark, page, page), root="http://x.y/").collect()}
    assert {k: v[0] for k, v in got.items()} == {"csn:1": datetime(2024, 1, 31, 2, 10, 41), "csn:2": datetime(2024, 7, 1, 3, 10, 41), "csn:4": datetime(2024, 7, 1, 3, 10, 41)}
    assert got["csn:1"][1] == {"magnitude": 4.0, "mag_type": "Mww", "depth_km": 33.5, "place": "30 km al O", "report_url": "http://x.y/x/1.html", "time_source": "utc_column"}
    assert got["csn:2"][1] == {"magnitude": 3.0, "place": "30 km al O", "report_url": "http://x.y/x/2.html", "time_source": "local_column"}
    assert "magnitude" not in got["csn:4"][1] and "depth_km" not in got["csn:4"][1]
    with pytest.raises(PySparkException, match="no table of quakes"):
        feeds.quake_table(frame(spark, "<p>Mantención</p>")).collect()


def test_a_catalogue_is_read_once(spark):
    """Conditions on what was read do not read it again: each pattern stands in the plan once for each use."""
    plan = feeds.quake_table(frame(spark, "<table></table>"))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count(r"\.html?$"), plan.count("regexp_extract_all"), plan.count("(script|style)")) == (1, 6, 3)


def test_odd_cells_of_a_catalogue(spark):
    row = lambda i, utc, depth, mag: f'<TR class="x"><TH><a class="y" HREF = \' /x/{i}.htm \'>2024-06-30\tT23:10</a> a&lt;b  é <script>no</script></TH><tdx>no</tdx><td\n>{utc}</td><td>-33.07&nbsp;-71.6</td><td>{depth}</td><Td>{mag}</Td></TR>'
    page = "<TABLE>" + row(1, " 2024-06-30T <b>23:10:41</b> ", "7 \n km", "<i>4.5</i>&nbsp;Mw") + row(2, "2024-06-30", "12km", "&#52; ") + "</TABLE>"
    got = {r["external_id"]: (r["ts"], json.loads(r["raw"])) for r in feeds.quake_table(frame(spark, page)).collect()}
    assert got["csn:1"] == (datetime(2024, 6, 30, 23, 10, 41), {"magnitude": 4.5, "mag_type": "Mw", "depth_km": 7.0, "place": "a<b é", "report_url": "/x/1.htm", "time_source": "utc_column"})
    assert got["csn:2"] == (datetime(2024, 7, 1, 3, 10), {"magnitude": 4.0, "depth_km": 12.0, "place": "a<b é", "report_url": "/x/2.htm", "time_source": "local_column"})


def test_pages_go_by_local_days(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 2, 30),), (datetime(2024, 1, 1, 3, 0),)], "now timestamp")
    got = [r[0] for r in df.select(feeds.catalogue_pages(F.col("now"), 2)).collect()]
    page = "sismicidad/catalogo/{0}/{1}/{0}{1}{2}.html".format
    assert got == [[page(2023, 12, 31), page(2023, 12, 30)], [page(2024, "01", "01"), page(2023, 12, 31)]]


def test_local_times_about_the_change_of_clocks(spark):
    """Against the standard library's zones, whose fold 0 is the first of two hours."""
    naive = [datetime(2024, m, d, h, 30) for m, d in ((1, 15), (4, 6), (4, 7), (7, 1), (9, 7), (9, 8)) for h in (0, 1, 22, 23)]
    df = spark.createDataFrame([(k, t.isoformat()) for k, t in enumerate(naive)], "k int, raw string")
    got = {r["k"]: r["t"] for r in df.select("k", text.local_timestamp(F.col("raw")).alias("t")).collect()}
    assert got == {k: t.replace(tzinfo=ZoneInfo("America/Santiago")).astimezone(UTC).replace(tzinfo=None) for k, t in enumerate(naive)}
    same = ["2024-01-15T10:00:00Z", "2024-01-15T07:00:00-03:00", "2024-01-15T07:00:00-0300", "1705312800", "1705312800000", "2024-01-15 07:00", "15-01-2024 07:00"]
    read = spark.createDataFrame([(x,) for x in same], "raw string").select(text.local_timestamp(F.col("raw")))
    assert {r[0] for r in read.collect()} == {datetime(2024, 1, 15, 10)}
    assert spark.createDataFrame([("soon",), (None,)], "raw string").select(text.local_timestamp(F.col("raw"))).distinct().collect() == [(None,)]


def test_entities(spark):
    said = ["a &amp;lt; b", "&Ntilde;u&ntilde;oa &#225;&#xE9;&#X1F600;", "&unknown; & &;", "&#128; &#x99; &#0; &#xD800; &#x110000;", "&nbsp;x&#160;y\u00a0", "sin", "", "&copy;", "&hearts;&NotEqualTilde;", "&#39;&quot;"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string")
    assert [r[0] for r in df.orderBy("k").select(text.unescape(F.col("x"))).collect()] == [html.unescape(x) for x in said]
    assert [r[0] for r in df.orderBy("k").select(text.strip_html(F.col("x"))).collect()] == [" ".join(html.unescape(x).split()) for x in said]
    assert spark.createDataFrame([(None,)], "x string").select(text.strip_html(F.col("x"))).first()[0] is None


def test_outages_as_features(spark):
    item = {"type": "Feature", "lat": "0", "geometry": {"type": "Point", "coordinates": [-71.5, -33.0]}, "properties": {"Codigo": "7", "Hora Inicio": "2024-02-01T06:00:00", "eta": "2024-02-01T18:30:00", "clientes": "1250.9", "comuna": "null"}}
    odd = {"id": "8", "ID": "9", "lat": "-33.0", "Lat": "-33.1", "lon": "-71.5", "geometry": None}
    rows = {r["external_id"]: r for r in feeds.outages(frame(spark, {"features": [item, None, odd]}), "cge", NOW).collect()}
    assert set(rows) == {"cge:7", "cge:9"} and rows["cge:7"]["ts"] == datetime(2024, 2, 1, 9) and rows["cge:7"]["commune"] is None
    assert json.loads(rows["cge:7"]["raw"]) == {"clients": 1250, "restoration": "2024-02-01T21:30:00.000Z"} and rows["cge:9"]["lat"] == -33.1


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"data": x}, lambda x: {"cortes": x}, lambda x: {"anything": x}])
def test_outage_envelopes(spark, wrap):
    items = [
        {"id": "1", "Latitud": "-33.0", "Longitud": "-71.5", "Clientes Afectados": "120", "hora_inicio": "2024-02-01T08:00:00", "comuna": "Quilpué"},
        {"latitud": "-33.1", "longitud": "-71.4", "clientes_afectados": "-5", "hora_inicio": "2024-02-01T18:00:00"},
        {"latitud": "-20.0", "longitud": "-71.4"},
    ]
    rows = feeds.outages(frame(spark, wrap(items)), "chilquinta", NOW).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [datetime(2024, 2, 1, 11), datetime(2024, 2, 1, 12)]
    assert json.loads(rows[0]["raw"])["clients"] == 120 and "clients" not in json.loads(rows[1]["raw"])
    assert rows[0]["external_id"] == "chilquinta:1" and rows[0]["commune"] == "Quilpué"


def test_no_outages_is_not_an_error_page(spark):
    assert feeds.outages(frame(spark, []), "cge", NOW).collect() == []
    with pytest.raises(PySparkException, match="no list of outages"):
        feeds.outages(frame(spark, "<html>"), "cge", NOW).collect()


def test_traffic(spark):
    base = {"uuid": "u", "type": "ACCIDENT", "location": {"x": -71.5, "y": -33.0}, "street": "Av. España", "city": "Valparaíso, Valparaíso", "pubMillis": 1706788000000}
    items = {"alerts": [base, {**base, "uuid": "old", "pubMillis": 1706700000000}, {**base, "uuid": "jam", "type": "JAM"}, {**base, "uuid": "off", "location": {"x": 0, "y": -200}}, {**base, "uuid": "none", "location": None}, {**base, "uuid": "undated", "pubMillis": None}]}
    rows = feeds.traffic(frame(spark, items), NOW).collect()
    assert [(r["external_id"], r["commune"], r["lat"]) for r in rows] == [("waze:u", "Valparaíso", -33.0)]
    assert feeds.traffic(frame(spark, {"other": 1}), NOW).collect() == []
    with pytest.raises(PySparkException):
        feeds.traffic(frame(spark, {"alerts": "x"}), NOW).collect()


def test_dispatches(spark):
    item = lambda t: f"<item><title>{t}</title><description>{t}</description><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate></item>"
    feed = "<rss><channel>" + "".join(item(t) for t in ("Clave 10-4 en ruta", "10-0-4 calle", "10-40 calle", "10-4-2024 fecha", "10-1 casa", "tel 322 10-4 <b>x</b>")) + "<item><title>10.4 sin fecha</title></item></channel></rss>"
    rows = feeds.dispatches(frame(spark, feed), NOW).collect()
    assert sorted(r["text"] for r in rows) == sorted(["Clave 10-4 en ruta", "10-0-4 calle", "tel 322 10-4 x", "10.4 sin fecha"])
    assert max(r["ts"] for r in rows) == datetime(2024, 2, 1, 12)
    with pytest.raises(PySparkException, match="no feed"):
        feeds.dispatches(frame(spark, "<html></html>"), NOW).collect()


def test_notices(spark):
    html = "<article><p>Accidente de tránsito en Av. España con Calle Uno. Precaución.</p></article><p>Corto</p><p>Tránsito suspendido por feria libre en el centro</p>"
    places = spark.createDataFrame([("Av. España", -33.03, -71.6)], "street string, lat double, lon double")
    rows = feeds.notices(frame(spark, html), NOW, places).collect()
    assert [(r["lat"], r["lon"]) for r in rows] == [(-33.03, -71.6)]


def test_notices_of_nested_blocks(spark):
    html = "<ul><li>Choque en <b>Ruta 68</b> a esta hora<ul><li>Accidente en Av. Brasil, personal en el lugar</li></ul></li></ul><article><p>Feria<p>Atropello en calle Uno con Dos</article><script>accidente en el codigo de la pagina</script>"
    assert sorted(r["text"] for r in feeds.notices(frame(spark, html), NOW).collect()) == ["Accidente en Av. Brasil, personal en el lugar", "Atropello en calle Uno con Dos"]


def test_failover_and_union(spark):
    def broken():
        return frame(spark, "x").select(F.raise_error(F.lit("down")).alias("payload"))

    def later():
        return spark.range(100, numPartitions=4).select(F.when(F.col("id") < 90, F.lit("x")).otherwise(F.raise_error(F.lit("late"))).alias("payload"))

    good = lambda: frame(spark, "x")
    df, attempts = feeds.first_that_answers(spark, {"a": broken, "b": later, "c": good, "d": good})
    assert df.count() == 1 and [(r["source"], r["ok"], r["rows"]) for r in attempts.collect()] == [("a", False, 0), ("b", False, 0), ("c", True, 1)]
    with pytest.raises(Exception, match="late"):
        feeds.first_that_answers(spark, {"a": broken, "b": later})
    df, attempts = feeds.union_of(spark, {"a": later, "b": good, "c": lambda: spark.sql("SELECT 'y' AS payload, 1 AS more")})
    assert sorted((r["payload"], r["more"]) for r in df.collect() if r["more"]) == [("y", 1)] and df.count() == 2 and attempts.where("ok").count() == 2
    with pytest.raises(Exception, match="down"):
        feeds.union_of(spark, {"a": broken})
    with pytest.warns(UserWarning, match="without rows"):
        assert feeds.first_that_answers(spark, {"empty": lambda: good().limit(0)})[0].count() == 0


def test_the_first_row_of_a_report_counts(spark):
    row = lambda lat: f'<tr><td><a href="/x/1.html">2024-01-30 23:10:41</a></td><td>2024-01-31 02:10:41</td><td>{lat} -71.6</td><td>33 km</td><td>4.1 Ml</td></tr>'
    got = feeds.quake_table(frame(spark, "<table>" + row(-33.5) + row(-33.0) + row(-32.5) + "</table>")).collect()
    assert [r["lat"] for r in got] == [-33.5]


def test_paged_source(spark, tmp_path):
    import json

    from signalloom.sources import pages

    for at in range(0, 25, 10):
        features = [{"id": str(i), "geometry": {"type": "Point", "coordinates": [-71.5, -33]}, "properties": {}} for i in range(at, min(25, at + 10))]
        (tmp_path / f"p{at}.json").write_text(json.dumps({"features": features, "exceededTransferLimit": at < 20}))
    url = f"file://{tmp_path}/p{{offset}}.json"
    walked = pages.pages(spark, url, page_rows=10)
    counted = pages.pages(spark, url, page_rows=10, total=25)
    assert feeds.features(walked).count() == feeds.features(counted).count() == 25
    assert counted.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="more than 2 pages"):
        pages.pages(spark, url, page_rows=10, most_pages=2).collect()
    assert pages.more_pages({"features": [1], "properties": {"exceededTransferLimit": True}}, 10) and not pages.more_pages({"features": [], "exceededTransferLimit": True}, 10)
    assert pages.more_pages({"features": [1, 2]}, 2) and not pages.more_pages({"features": [1]}, 2)
    one, two = pages.wfs_query("fires", "1.1.0", 5), pages.wfs_query("fires", most=5)
    assert (one["typeName"], one["maxFeatures"]) == ("fires", 5) == (two["typeNames"], two["count"])
    with pytest.raises(ValueError):
        pages.wfs_query(None)
    assert "resultOffset=20" in pages.PageReader({"url": "http://x/query", "page_rows": "10"}).page_url(20)


def test_any_timestamp(spark):
    raw = ["1706700000", "1706700000000", "2024-01-31T10:00:00", "31-01-2024 10:00", "31/01/2024", "x", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "t string").select(text.any_timestamp(F.col("t"))).collect()]
    assert got[0] == got[1] == datetime(2024, 1, 31, 11, 20) and got[2] == got[3] == datetime(2024, 1, 31, 10) and got[4] == datetime(2024, 1, 31) and got[5:] == [None, None]
