"""Registered queries over records: details, links, runs, readings and source payloads, with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.adapter import NOW, linked, signals
from signalloom.functions import cases, geo, text
from signalloom.operators import alerts, listing, store
from signalloom.plans.catalog import PRESENT, _REFRESH, incidents, query, stamp
from signalloom.sources import feeds

# --- Lookups, neighbours, visibility ----------------------------------------------------------

_AWAY = geo.spheroid("-33.02e0", "-71.55e0", "lat", "lon")


@query("p06_neighbours_of", f"""SELECT id, ts, round({_AWAY}, 2) AS distance_m FROM signals WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'
 AND id <> 17 AND {_AWAY} <= 40000e0""")
def neighbours_of(spark, d):
    found = listing.neighbours_of(signals(spark, d), -33.02, -71.55, stamp("2024-01-15 00:00:00"), 40000.0, 5 * 1440, 17)
    return found.select("id", "ts", F.round("distance_m", 2).alias("distance_m"))


@query("p10_region_match", "SELECT id FROM signals WHERE contains(lower(strip_accents(commune)), 'vina del mar') OR contains('vina del mar', lower(strip_accents(commune)))")
def region_match(spark, d):
    rows = signals(spark, d).withColumn("_p", F.expr(cases.plain_text("commune")))
    return rows.where(F.contains("_p", F.lit("vina del mar")) | F.contains(F.lit("vina del mar"), F.col("_p"))).select("id")


@query("p11_lookup", "SELECT id, external_id FROM signals WHERE source = 'waze' AND external_id = 'waze:33'")
def lookup(spark, d):
    return signals(spark, d).where((F.col("source") == "waze") & (F.col("external_id") == "waze:33")).select("id", "external_id")


@query("p13_visible", f"SELECT id FROM signals WHERE {cases.family('type')} IN ('power', 'fire') AND (type <> 'power_outage' OR source NOT IN ('chilquinta', 'cge') OR source = 'cge')")
def visible(spark, d):
    return listing.visible(signals(spark, d), ("power", "fire"), ("cge",)).select("id")


# --- Details, links, runs ---------------------------------------------------------------------

_DETAILS = """, details AS (SELECT id AS raw_event_id, source AS provider, magnitude, depth_km FROM signals WHERE type = 'earthquake' AND id % 3 <> 0),
 renewed AS (SELECT id AS raw_event_id, 'renewed' AS provider, CASE WHEN id % 5 = 0 THEN NULL ELSE magnitude END AS magnitude, depth_km + 1e0 AS depth_km FROM signals WHERE type = 'earthquake' AND id % 3 <> 1)"""


def _details(spark, d) -> tuple[DataFrame, DataFrame]:
    quakes = signals(spark, d).where("type = 'earthquake'")
    old = quakes.where("id % 3 <> 0").selectExpr("id AS raw_event_id", "source AS provider", "magnitude", "depth_km")
    return old, quakes.where("id % 3 <> 1").selectExpr("id AS raw_event_id", "'renewed' AS provider", "CASE WHEN id % 5 = 0 THEN NULL ELSE magnitude END AS magnitude", "depth_km + 1e0 AS depth_km")


@query("k03_detail_upsert", _DETAILS + " SELECT raw_event_id, provider, magnitude, depth_km FROM renewed UNION ALL SELECT * FROM details WHERE raw_event_id NOT IN (SELECT raw_event_id FROM renewed)")
def detail_upsert(spark, d):
    return store.upsert_by(*_details(spark, d), ["raw_event_id"])


@query("k04_link_upsert", ", old AS (SELECT incident_id, id AS event_id, 1e0 AS link_confidence FROM linked WHERE id % 4 < 3), new AS (SELECT incident_id, id AS event_id, 0.5e0 AS link_confidence FROM linked WHERE id % 4 > 1) SELECT * FROM new UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.incident_id = o.incident_id AND n.event_id = o.event_id) /* linked */")
def link_upsert(spark, d):
    rows = linked(signals(spark, d)).select("incident_id", F.col("id").alias("event_id"))
    old = rows.where("event_id % 4 < 3").withColumn("link_confidence", F.lit(1.0))
    return store.upsert_by(old, rows.where("event_id % 4 > 1").withColumn("link_confidence", F.lit(0.5)), ["incident_id", "event_id"])


@query("k08_run_log", """SELECT source AS collector, count(*) AS fetched, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-25 00:00:00') AS rejected,
 CASE WHEN count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-25 00:00:00') > 0 THEN 'partial' ELSE 'success' END AS status FROM signals GROUP BY source""")
def run_log(spark, d):
    runs = signals(spark, d).groupBy(F.col("source").alias("collector")).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("ts") > stamp("2024-01-25 00:00:00")).alias("rejected"))
    return runs.withColumn("status", store.run_status(F.col("rejected"), F.lit(0), F.lit(None).cast("string")))


@query("t07_latest_runs", "SELECT id, started_at FROM (SELECT id, ts AS started_at FROM signals) ORDER BY started_at DESC, id LIMIT 20")
def latest_runs(spark, d):
    return store.latest_runs(signals(spark, d).selectExpr("id", "ts AS started_at"))


@query("j05_incident_signals", " SELECT incident_id, id, row_number() OVER (PARTITION BY incident_id ORDER BY confidence DESC, ts, id) AS place FROM linked /* linked */")
def incident_signals(spark, d):
    links = linked(signals(spark, d)).select("incident_id", F.col("id").alias("event_id"))
    order = Window.partitionBy("incident_id").orderBy(F.col("confidence").desc(), "ts", "id")
    joined = links.join(signals(spark, d), F.col("event_id") == F.col("id"))
    return joined.select("incident_id", "id", F.row_number().over(order).cast("long").alias("place"))


@query("j06_quakes_with_details", _DETAILS + " SELECT s.id, s.ts, d.provider, d.depth_km FROM signals s JOIN details d ON s.id = d.raw_event_id")
def quakes_with_details(spark, d):
    return signals(spark, d).select("id", "ts").join(_details(spark, d)[0], F.col("id") == F.col("raw_event_id")).select("id", "ts", "provider", "depth_km")


@query("j10_rules", f"SELECT id, {cases.rule('source', 'ceiling')} AS ceiling, {cases.baseline('source')} AS baseline, {cases.family('type')} AS family FROM signals")
def rules(spark, d):
    table = spark.createDataFrame([(s, float(r.ceiling), P.BASELINE.get(s, P.UNKNOWN_BASELINE)) for s, r in P.RULES.items()], "rule_source string, ceiling double, baseline double")
    joined = signals(spark, d).join(F.broadcast(table), F.col("source") == F.col("rule_source"), "left")
    return joined.select("id", F.coalesce("ceiling", F.lit(float(P.DEFAULT_RULE.ceiling))).alias("ceiling"), F.coalesce("baseline", F.lit(P.UNKNOWN_BASELINE)).alias("baseline"), F.expr(cases.family("type")).alias("family"))


@query("a13_first_reports", "SELECT external_id, min(id) AS id FROM signals WHERE external_id IS NOT NULL GROUP BY external_id")
def first_reports(spark, d):
    return signals(spark, d).where("external_id IS NOT NULL").groupBy("external_id").agg(F.min("id").alias("id"))


@query("a15_without_commune", _REFRESH + " SELECT count(*) FILTER (WHERE commune IS NULL OR commune = '') AS without_commune, count(*) AS total FROM incidents /* linked */")
def without_commune(spark, d):
    return incidents(spark, d).agg(F.count_if(F.coalesce(F.col("commune"), F.lit("")) == "").alias("without_commune"), F.count(F.lit(1)).alias("total"))


@query("a17_counts", "SELECT count(*) AS n FROM signals WHERE source IN ('conaf', 'waze') AND confidence >= 0.4e0 - 1e-6")
def counts(spark, d):
    return listing.filter_events(signals(spark, d), sources=("conaf", "waze"), least=0.4).agg(F.count(F.lit(1)).alias("n"))


@query("t05_open_incidents", _REFRESH + " SELECT incident_id, last_seen_at FROM incidents WHERE status IN ('active', 'controlled') ORDER BY last_seen_at DESC, incident_id LIMIT 1000 /* linked */")
def open_incidents(spark, d):
    return listing.filter_incidents(incidents(spark, d)).orderBy(F.col("last_seen_at").desc(), "incident_id").limit(1000).select("incident_id", "last_seen_at")


@query("t08_newest_of_layer", f"SELECT layer, id, place FROM (SELECT {cases.family('type')} AS layer, id, row_number() OVER (PARTITION BY {cases.family('type')} ORDER BY ts DESC, id) AS place FROM signals) WHERE place <= 50")
def newest_of_layer(spark, d):
    rows = signals(spark, d).select(F.expr(cases.family("type")).alias("layer"), "id", "ts")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(F.col("ts").desc(), "id")).cast("long")).where("place <= 50").drop("ts")


# --- Scalar readings --------------------------------------------------------------------------


@query("f02_timestamps", "SELECT id, ts AS read_at FROM signals")
def timestamps(spark, d):
    ways = "CASE id % 4 WHEN 0 THEN CAST(unix_millis(ts) AS STRING) WHEN 1 THEN CAST(unix_timestamp(ts) AS STRING) WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") ELSE date_format(ts, 'dd-MM-yyyy HH:mm:ss') END"
    rows = signals(spark, d).where("id IS NOT NULL").withColumn("_raw", F.expr(ways))
    read = text.any_timestamp(F.col("_raw"))
    return rows.select("id", F.when(F.date_trunc("second", read) == F.date_trunc("second", "ts"), F.col("ts")).alias("read_at"))


@query("f06_acquisition", "SELECT id, CASE WHEN id % 100 < 60 AND (id % 2500) // 100 < 24 THEN TIMESTAMP '2024-01-15 00:00:00' + to_minutes(CAST((id % 2500) // 100 * 60 + id % 100 AS BIGINT)) END AS acquired FROM signals")
def acquisition(spark, d):
    return signals(spark, d).select("id", text.acquisition_time(F.lit("2024-01-15"), (F.col("id") % 2500).cast("string")).alias("acquired"))


@query("f10_f15_alert_views", """SELECT id AS alert_id, CASE WHEN contains(t, 'roja') THEN 'roja' WHEN contains(t, 'amarilla') THEN 'amarilla' WHEN contains(t, 'preventiva') THEN 'temprana_preventiva' WHEN contains(t, 'verde') THEN 'verde' ELSE 'otra' END AS level,
 CASE WHEN regexp_matches(t, 'incendio|forestal|fuego|humo') THEN 'fire' WHEN regexp_matches(t, 'inundacion|crecida|aluvion|remocion|deslizamiento|lluvia|marejada') THEN 'hydro' ELSE 'unknown' END AS family, contains(t, 'toda la region') AS regional
 FROM (SELECT id, lower(strip_accents(text)) AS t FROM signals WHERE type IN ('alert', 'evacuation'))""")
def alert_readings(spark, d):
    return alerts.alert_views(signals(spark, d).where("type IN ('alert', 'evacuation')")).select("alert_id", "level", "family", "regional")


@query("f25_plain_pages", """SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
 '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\\s\\x{a0}]+', ' ', 'g'))) AS plain FROM pages""")
def plain_pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("plain"))


@query("f26_aliases", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def aliases(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("_m", F.from_json("props", "map<string,string>"))
    return rows.select(F.col("event_id").alias("id"), feeds.alias(F.col("_m"), "clave", "K").cast("long").alias("k"))


@query("f27_titles", f"SELECT id, {cases.title(cases.incident_type('type'), 'commune')} AS title FROM signals")
def titles(spark, d):
    return signals(spark, d).selectExpr("id", f"{cases.title(cases.incident_type('type'), 'commune')} AS title")


@query("f32_formats", f"SELECT id, {cases.ago(f'date_diff({chr(39)}second{chr(39)}, ts, {NOW})', 'VARCHAR')} AS ago, {cases.percent('confidence', 'VARCHAR')} AS percent FROM signals")
def formats(spark, d):
    return signals(spark, d).selectExpr("id", f"{cases.ago(f'unix_timestamp({NOW}) - unix_timestamp(ts)', 'STRING')} AS ago", f"{cases.percent('confidence', 'STRING')} AS percent")


@query("f33_f38_symbols", _REFRESH + f"SELECT incident_id, {cases.closed('status')} AS is_closed, {cases.marker(cases.level('confidence'))} AS marker FROM incidents /* linked */")
def symbols(spark, d):
    return incidents(spark, d).selectExpr("incident_id", f"{cases.closed('status')} AS is_closed", f"{cases.marker(cases.level('confidence'))} AS marker")


@query("x08_staleness", f"SELECT id, date_diff('second', ts, {NOW}) > 180 AS is_stale FROM signals")
def staleness(spark, d):
    return signals(spark, d).select("id", (F.unix_timestamp(stamp(PRESENT)) - F.unix_timestamp("ts") > 180).alias("is_stale"))


# --- Source payloads: one a row, made from the events -----------------------------------------


def _payloads(spark, d, expression: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr(f"{expression} AS payload")


def _counted(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query("n01_satellite", """SELECT TIMESTAMP '2024-01-15 00:00:00' + to_minutes(CAST((event_id % 2500) // 100 * 60 + event_id % 100 AS BIGINT)) AS ts, CASE event_id % 3 WHEN 0 THEN 0.3e0 WHEN 1 THEN 0.55e0 ELSE 0.85e0 END AS confidence, count(*) AS n
 FROM events WHERE event_id % 100 < 60 AND (event_id % 2500) // 100 < 24 GROUP BY ALL""")
def satellite(spark, d):
    table = "concat('latitude,longitude,acq_date,acq_time,satellite,instrument,confidence\\n-33.5,-71.5,2024-01-15,', event_id % 2500, ',N,VIIRS,', CASE event_id % 3 WHEN 0 THEN 'l' WHEN 1 THEN 'n' ELSE '99' END)"
    return _counted(feeds.satellite(_payloads(spark, d, table), "VIIRS").select("ts", F.round(F.col("confidence").cast("double"), 4).alias("confidence")), "ts", "confidence")


@query("n02_wildfires", "SELECT 'conaf:' || CAST(event_id AS VARCHAR) AS external_id, 'wildfire' AS type, -33e0 - event_id % 5 / 1e1 AS lat FROM events WHERE event_id % 3 <> 0")
def wildfires(spark, d):
    feature = """concat('{"features":[{"id":"', event_id, '","geometry":{"type":"Point","coordinates":[-71.5,-33.', event_id % 5, ']},"properties":{"estado":"Activo","f_inicio":1706700000000,"region":"', CASE WHEN event_id % 3 = 0 THEN 'Maule' ELSE 'Valparaíso' END, '"}}]}')"""
    return feeds.wildfires(_payloads(spark, d, feature)).select("external_id", "type", "lat")


@query("n03_alert_layer", "SELECT CASE WHEN event_id % 2 = 0 THEN 'evacuation' ELSE 'alert' END AS type, 'Limache ' || CAST(event_id AS VARCHAR) AS commune FROM events WHERE event_id % 5 <> 0")
def alert_layer(spark, d):
    feature = """concat('{"features":[{"geometry":null,"properties":{"Region":"', CASE WHEN event_id % 5 = 0 THEN 'Maule' ELSE 'Valparaíso' END, '","Alerta":"Alerta Roja","Razon":"', CASE WHEN event_id % 2 = 0 THEN 'Evacuación preventiva' ELSE 'Fuego' END, '","Comunas":"Limache ', event_id, '","Actualizado":1706700000000}}]}')"""
    return feeds.alert_layer(_payloads(spark, d, feature)).select("type", "commune")


@query("n04_quakes", "SELECT 'usgs:q' || CAST(event_id AS VARCHAR) AS external_id, CASE WHEN event_id % 7 = 0 THEN 'Sismo de magnitud no determinada' ELSE 'Sismo de magnitud ' || CAST(event_id % 6 AS VARCHAR) || '.5' END AS text FROM events WHERE (event_id % 7 = 0 OR event_id % 6 >= 2) AND event_id % 11 <> 0")
def quakes(spark, d):
    feature = """concat('{"metadata":{"status":200},"features":[{"id":"q', event_id, '","geometry":{"type":"Point","coordinates":[', CASE WHEN event_id % 11 = 0 THEN '-60' ELSE '-71.5' END, ',-33,10]},"properties":{"type":"earthquake","time":1706700000000,"mag":', CASE WHEN event_id % 7 = 0 THEN 'null' ELSE concat(event_id % 6, '.5') END, '}}]}')"""
    return feeds.quakes(_payloads(spark, d, feature)).select("external_id", "text")


@query("s11_feed_counts", "SELECT count(*) * 5 AS features, CAST(sum(3 + event_id % 2) AS BIGINT) AS unreadable FROM events")
def feed_counts(spark, d):
    point = """'{"id":"q', event_id, '","geometry":{"type":"Point","coordinates":[-71.5,-33,10]},"properties":{}}'"""
    odd = """CASE WHEN event_id % 2 = 1 THEN '{"id":"r","geometry":null,"properties":{}}' ELSE '{"id":"r","geometry":{"type":"Point","coordinates":[0,1]}}' END"""
    answer = f"""concat('{{"features":[', {point}, ',null,{{"id":" ","geometry":{{"type":"Point","coordinates":[1,2]}}}},', {odd}, ',{{"id":"s","geometry":{{"type":"Point","coordinates":["x",2]}}}}]}}')"""
    return feeds.features(_payloads(spark, d, answer), nulls=True).agg(F.count(F.lit(1)).alias("features"), feeds.unreadable().alias("unreadable"))


@query("s12_catalogue_pages", """SELECT id, k, strftime(timezone('America/Santiago', timezone('UTC', ts)) - to_days(CAST(k AS INTEGER)), 'sismicidad/catalogo/%Y/%m/%Y%m%d.html') AS page
 FROM signals, (VALUES (0), (1), (2)) AS t(k) WHERE ts IS NOT NULL""")
def catalogue_pages(spark, d):
    return signals(spark, d).where("ts IS NOT NULL").select("id", F.posexplode(feeds.catalogue_pages(F.col("ts"), 3)).alias("k", "page"))


@query("f07_local_times", """SELECT id, CASE WHEN id % 4 < 2 THEN timezone('UTC', timezone('America/Santiago', date_trunc('second', ts))) ELSE date_trunc('second', ts) END AS read_at FROM signals WHERE id IS NOT NULL""")
def local_times(spark, d):
    ways = "CASE id % 4 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 1 THEN date_format(ts, 'dd-MM-yyyy HH:mm:ss') WHEN 2 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") ELSE CAST(unix_timestamp(ts) AS STRING) END"
    return signals(spark, d).where("id IS NOT NULL").select("id", text.local_timestamp(F.expr(ways)).alias("read_at"))


@query("n05_s12_quake_table", """SELECT 'csn:' || CAST(event_id * 3 + 1 AS VARCHAR) AS external_id, TIMESTAMP '2024-07-31 02:10:41' AS ts, CASE WHEN event_id % 1000 <= 800 THEN CAST(event_id % 1000 AS DOUBLE) END AS depth_km,
 CASE WHEN event_id % 13 <= 10 THEN event_id % 13 + 0.5e0 END AS magnitude, CASE WHEN event_id % 13 <= 10 THEN 'Mlv' END AS mag_type, '30 km al O de Lugar ' || CAST(event_id % 7 AS VARCHAR) AS place,
 CASE WHEN event_id % 2 = 0 THEN 'utc_column' ELSE 'local_column' END AS time_source FROM events GROUP BY event_id""")
def quake_table(spark, d):
    utc = "CASE WHEN event_id % 2 = 0 THEN '2024-07-31 02:10:41' ELSE '' END"

    def row(link: str, spot: str, size: str) -> str:
        return f"""'<tr><td><a href="/x/', {link}, '.html">2024-07-30 22:10:41</a><br>30 km al O de Lugar ', event_id % 7, '</td><td>', {utc}, '</td><td>{spot}</td><td>', event_id % 1000, ' km</td><td>', {size}, ' Mlv</td></tr>'"""

    rows = [row("event_id * 3 + 1", "-33.0 -71.6", "event_id % 13, '.5'"), row("event_id * 3 + 1", "-33.1 -71.7", "'1.0'"), row("event_id * 3 + 2", "-20.0 -69.0", "'5.0'"), row("'abc'", "-33.0 -71.6", "'4.0'")]
    page = f"concat('<table><tr><th>x</th></tr>', {', '.join(rows)}, '</table>')"
    names = ("depth_km", "magnitude", "mag_type", "place", "time_source")
    found = feeds.quake_table(_payloads(spark, d, page))
    return found.select("external_id", "ts", F.json_tuple("raw", *names).alias(*names)).withColumns({n: F.col(n).cast("double") for n in ("depth_km", "magnitude")})


@query("n06_s16_outages", """SELECT 'cge:' || CAST(event_id AS VARCHAR) AS external_id, CASE WHEN event_id % 2 = 0 THEN timezone('UTC', timezone('America/Santiago', TIMESTAMP '2024-01-30 10:00:00')) ELSE TIMESTAMP '2024-01-31 00:00:00' END AS ts, CAST(12 AS BIGINT) AS clients FROM events WHERE event_id % 9 <> 0
 UNION ALL SELECT 'cge:f' || CAST(event_id AS VARCHAR), TIMESTAMP '2024-01-30 10:00:00', CASE WHEN event_id % 4 > 0 THEN event_id % 4 END FROM events""")
def outages(spark, d):
    plain = """'{"ID":"', event_id, '","Latitud":"', CASE WHEN event_id % 9 = 0 THEN '-20' ELSE '-33' END, '","Longitud":"-71.5","Clientes Afectados":"12"', CASE WHEN event_id % 2 = 0 THEN ',"hora_inicio":"2024-01-30T10:00:00"' ELSE '' END, '}'"""
    feature = """'{"type":"Feature","lat":"0","geometry":{"type":"Point","coordinates":[-71.5,-33.1]},"properties":{"codigo":"f', event_id, '","horaInicio":"2024-01-30T10:00:00Z","clientes":"', CASE WHEN event_id % 4 = 0 THEN '-5' ELSE event_id % 4 END, '"}}'"""
    answer = f"""concat(CASE event_id % 3 WHEN 0 THEN '[' WHEN 1 THEN '{{"cortes":[' ELSE '{{"whatever":[' END, {plain}, ',', {feature}, ',null,{{"ID":"unplaced"}}', CASE event_id % 3 WHEN 0 THEN ']' ELSE ']}}' END)"""
    return feeds.outages(_payloads(spark, d, answer), "cge", PRESENT).select("external_id", "ts", F.get_json_object("raw", "$.clients").cast("long").alias("clients"))


@query("n07_s15_traffic", "SELECT 'waze:' || CAST(event_id AS VARCHAR) AS external_id, 'Quilpué' AS commune FROM events WHERE event_id % 3 = 0 AND event_id % 200 <= 120")
def traffic(spark, d):
    answer = f"""concat('{{"alerts":[{{"uuid":"', event_id, '","type":"', CASE WHEN event_id % 3 = 0 THEN 'ACCIDENT' ELSE 'JAM' END, '","city":"Quilpué, Valparaíso","location":{{"x":-71.5,"y":-33}},"pubMillis":', (unix_timestamp({NOW}) - event_id % 200 * 60) * 1000, '}}]}}')"""
    return feeds.traffic(_payloads(spark, d, answer), PRESENT).select("external_id", "commune")


@query("n08_s14_dispatches", "SELECT 'Clave ' || CASE event_id % 4 WHEN 0 THEN '10-4' ELSE '10-0-4' END || ' en ruta ' || CAST(event_id AS VARCHAR) AS text, TIMESTAMP '2024-01-30 10:00:00' AS ts FROM events WHERE event_id % 4 < 2")
def dispatches(spark, d):
    feed = "concat('<rss><item><title>Clave ', CASE event_id % 4 WHEN 0 THEN '10-4' WHEN 1 THEN '10-0-4' WHEN 2 THEN '10-40' ELSE '10-1' END, ' en ruta ', event_id, '</title><pubDate>Tue, 30 Jan 2024 10:00:00 GMT</pubDate></item></rss>')"
    return feeds.dispatches(_payloads(spark, d, feed), PRESENT).select("text", "ts")


@query("n09_s13_notices", "SELECT 'Choque ' || CAST(event_id AS VARCHAR) || ' en Avenida Uno con Calle Dos.' AS text, -33.03e0 AS lat FROM events WHERE event_id % 2 = 0")
def notices(spark, d):
    page = "concat('<article><p>', CASE WHEN event_id % 2 = 0 THEN 'Choque ' ELSE 'Feria ' END, event_id, ' en Avenida Uno con Calle Dos.</p></article><p>Corto</p>')"
    places = spark.createDataFrame([("Avenida Uno", -33.03, -71.6)], "street string, lat double, lon double")
    return feeds.notices(_payloads(spark, d, page), PRESENT, places).select("text", "lat")
