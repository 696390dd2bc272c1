"""Source payloads to signals: one row a payload in, one row a record out, with built-in expressions only.

Readers take a DataFrame with a string column `payload` (a whole file or response). An answer that is an error, or
that lacks its envelope, fails the query; an empty envelope gives no rows. Records that cannot be read are left out
or, where the record is known but a field is not, carry nulls. Signals have COLUMNS.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases, geo, text
from signalloom.tables import materialise

COLUMNS = ("ts", "source", "type", "lat", "lon", "text", "external_id", "confidence", "commune", "province", "raw")

_FEATURES = "struct<error:string,metadata:struct<status:int>,features:array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"


def payloads(spark, path: str) -> DataFrame:
    """Whole files as rows of `payload`."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def signal(df: DataFrame, source: Column | str, **columns: Column) -> DataFrame:
    """COLUMNS of df, named ones from their expressions, others null."""
    columns = {"source": F.lit(source) if isinstance(source, str) else source, **columns}
    kinds = {"ts": "timestamp", "lat": "double", "lon": "double", "confidence": "float"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def alias(properties: Column, *names: str) -> Column:
    """The first non-blank value under any of the names, whatever their case; of keys that differ in case only, the first with a value."""
    return first_value(F.map_entries(properties), lambda k: F.lower(k), *[n.lower() for n in names])


def first_value(entries: Column, reading, *names: str) -> Column:
    """The first non-blank value among (key, value) entries under the first of the names that has one; keys are read by `reading`."""
    found = lambda n: F.get(F.filter(entries, lambda e: (reading(e["key"]) == n) & (F.trim(e["value"]) != "")), F.lit(0))
    return F.coalesce(*[F.trim(found(n)["value"]) for n in names])


def features(df: DataFrame, nulls: bool = False) -> DataFrame:
    """(feature_id, lat, lon, depth, properties) of feature collections; the point of a shape is the middle of its box.

    Features that are null are left out, or with nulls give rows of nulls.
    """
    parsed = df.withColumn("_p", F.from_json("payload", _FEATURES))
    failed = F.col("_p.error").isNotNull() | F.col("_p").isNull() | F.col("_p.features").isNull() | (F.coalesce("_p.metadata.status", F.lit(200)) != 200)
    rows = parsed.select(F.explode(F.when(failed, F.raise_error(F.concat(F.lit("no feature collection: "), F.substring("payload", 1, 120)))).otherwise(F.col("_p.features"))).alias("f"))
    rows = rows if nulls else rows.where("f IS NOT NULL")
    pair = r"\[\s*(-?[0-9.eE+-]+)\s*,\s*(-?[0-9.eE+-]+)"
    numbers = lambda k: F.transform(F.regexp_extract_all("f.geometry.coordinates", F.lit(pair), F.lit(k)), lambda x: x.try_cast("double"))
    middle = lambda k: (F.array_min(numbers(k)) + F.array_max(numbers(k))) / 2
    depth = F.regexp_extract("f.geometry.coordinates", pair + r"\s*,\s*(-?[0-9.eE+-]+)", 3).try_cast("double")
    return rows.select(F.col("f.id").alias("feature_id"), middle(2).alias("lat"), middle(1).alias("lon"), depth.alias("depth"), F.col("f.properties").alias("properties"))


def axes_mended(df: DataFrame) -> DataFrame:
    """Swaps latitude and longitude where only the longitude looks like a latitude of the country."""
    swap = ~F.col("lat").between(-57, -17) & F.col("lon").between(-57, -17)
    return df.withColumns({"lat": F.when(swap, F.col("lon")).otherwise(F.col("lat")), "lon": F.when(swap, F.col("lat")).otherwise(F.col("lon"))})


def satellite(df: DataFrame, sensor: str) -> DataFrame:
    """Thermal anomalies from CSV payloads; a header without latitude is an error text, not an empty answer."""
    lines = F.filter(F.split("payload", r"\r?\n"), lambda x: F.trim(x) != "")
    head = F.split(F.lower(F.get(lines, F.lit(0))), ",")
    good = (F.size(lines) == 0) | F.coalesce(F.array_contains(head, "latitude"), F.lit(False))
    body = F.when(good, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(F.raise_error(F.concat(F.lit("no satellite table: "), F.substring("payload", 1, 120))))
    rows = df.withColumn("_head", head).withColumn("_row", F.explode(body)).withColumn("_m", F.map_from_arrays("_head", F.slice(F.concat(F.split("_row", ","), F.array_repeat(F.lit(None).cast("string"), 40)), 1, F.size("_head"))))
    get = lambda c: F.try_element_at(F.col("_m"), F.lit(c))
    rows = rows.withColumn("lat", get("latitude").try_cast("double")).withColumn("lon", get("longitude").try_cast("double")).withColumn("ts", text.acquisition_time(get("acq_date"), get("acq_time")))
    rows = rows.where("lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL")
    ident = text.external_id("firms", F.lit(sensor), get("satellite"), get("instrument"), get("acq_date"), get("acq_time"), F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon"))
    return signal(rows, "nasa_firms", ts=F.col("ts"), type=F.lit("thermal_anomaly"), lat=F.col("lat"), lon=F.col("lon"), external_id=ident, confidence=text.satellite_confidence(get("confidence")), text=F.concat_ws(" ", F.lit("Anomalía térmica"), F.lit(sensor)), raw=F.to_json("_m"))


def wildfires(df: DataFrame, regions: tuple[str, ...] = ("valparaiso",)) -> DataFrame:
    """Fires of the agency's layer in the regions named, or in the region's box where none is given; the first known date counts."""
    p = F.col("properties")
    rows = axes_mended(features(df).withColumns({"lat": F.coalesce("lat", alias(p, "lat", "latitud").try_cast("double")), "lon": F.coalesce("lon", alias(p, "lon", "longitud").try_cast("double"))}))
    rows = rows.withColumn("_region", alias(p, "region", "nom_region")).withColumn("_plain", F.expr(cases.plain_text("_region")))
    named = F.exists(F.array(*[F.lit(r) for r in regions]), lambda r: F.contains(F.col("_plain"), r) | F.contains(r, F.col("_plain")))
    rows = rows.where(F.when(F.col("_region").isNotNull(), named).otherwise(F.coalesce(F.expr(geo.in_box("lat", "lon", P.REGION_BOX)), F.lit(False))))
    ts = F.coalesce(*[text.any_timestamp(alias(p, *names)) for names in (("f_inicio", "fecha_inicio"), ("f_control", "fecha_control"), ("f_extincion", "fecha_extincion"))])
    rows = rows.withColumn("ts", ts).where("ts IS NOT NULL")
    name, state = alias(p, "nombre", "nombre_incendio"), alias(p, "estado", "estado_incendio", "situacion", "status")
    ident = F.coalesce(F.concat(F.lit("conaf:"), F.coalesce(alias(p, "id", "id_incendio", "codigo"), "feature_id")), text.external_id("conaf:h", name, ts, alias(p, "comuna")))
    said = F.concat(F.lit('Incendio forestal "'), F.coalesce(name, F.lit("sin nombre")), F.lit('" — estado: '), F.coalesce(state, F.lit("estado no informado")), F.lit("."))
    return signal(rows, "conaf", ts=F.col("ts"), type=F.lit("wildfire"), lat=F.col("lat"), lon=F.col("lon"), text=said, external_id=ident, confidence=F.lit(1.0), commune=alias(p, "comuna", "nom_comuna"), province=alias(p, "provincia"), raw=F.to_json("properties"))


def alert_layer(df: DataFrame, regions: tuple[str, ...] = ("valparaiso",), national: bool = True) -> DataFrame:
    """Alerts and evacuations of the regions named, and national ones; they bring no place."""
    p = F.col("properties")
    said = F.concat_ws(". ", alias(p, "Alerta"), alias(p, "Evento"), alias(p, "Razon"))
    rows = features(df).withColumn("said", said).withColumn("id", F.lit(0)).withColumn("_said", F.expr(cases.plain_text("said"))).withColumn("_area", F.concat_ws(" ", alias(p, "Region"), alias(p, "Ambito"))).withColumn("_plain", F.expr(cases.plain_text("_area")))
    wide = F.contains(F.col("_plain"), F.lit("nacional"))
    rows = rows.where(F.exists(F.array(*[F.lit(r) for r in regions]), lambda r: F.contains(F.col("_plain"), r)) | (wide & F.lit(national)))
    out = F.exists(F.array(*[F.lit(w) for w in P.EVACUATION_WORDS]), lambda w: F.contains(F.col("_said"), w))
    ident = text.external_id("senapred", *[F.lower(F.trim(alias(p, c))) for c in ("Region", "Alerta", "Razon", "Evento", "Comunas", "Ambito")])
    ts = F.coalesce(text.any_timestamp(alias(p, "Fecha")), text.any_timestamp(alias(p, "Actualizado")))
    return signal(rows, "senapred", ts=ts, type=F.when(out, "evacuation").otherwise("alert"), text=F.col("said"), external_id=ident, confidence=F.lit(1.0), commune=alias(p, "Comunas"), raw=F.to_json("properties"))


def unreadable() -> Column:
    """How many of the rows of features(nulls=True) no quake can be read of: those without an id or a point."""
    return F.count_if(F.coalesce(F.trim("feature_id"), F.lit("")).eqNullSafe("") | F.col("lat").isNull() | F.col("lon").isNull())


def quakes(df: DataFrame, box: tuple = P.SEISMIC_BOX, least: float = 2.5, seen: Observation | None = None) -> DataFrame:
    """Quakes of a feed inside the box; an unknown magnitude passes the least one.

    seen, if given, observes `features` and `unreadable` in the pass that reads the feed.
    """
    p = F.col("properties")
    magnitude = alias(p, "mag").try_cast("double")
    rows = features(df, nulls=True)
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("features"), unreadable().alias("unreadable"))
    rows = rows.withColumn("magnitude", magnitude).where(F.coalesce(alias(p, "type"), F.lit("earthquake")) == "earthquake")
    rows = rows.where((F.trim("feature_id") != "") & F.expr(geo.in_box("lat", "lon", box)) & F.coalesce(F.col("magnitude") >= least, F.lit(True)))
    said = F.when(F.col("magnitude").isNull(), "Sismo de magnitud no determinada").otherwise(F.format_string("Sismo de magnitud %.1f", "magnitude"))
    raw = F.to_json(F.struct("magnitude", F.col("depth").alias("depth_km"), alias(p, "place").alias("place"), (alias(p, "tsunami") == "1").alias("tsunami"), alias(p, "felt").try_cast("int").alias("felt"), alias(p, "status").alias("status")))
    return signal(rows, "usgs", ts=text.any_timestamp(alias(p, "time")), type=F.lit("earthquake"), lat=F.col("lat"), lon=F.col("lon"), text=said, external_id=F.concat(F.lit("usgs:"), "feature_id"), confidence=F.lit(1.0), raw=raw)


#: What a catalogue's cells can hold. Anything else was read from the wrong cell.
CATALOGUE_BOX = (-115.0, -60.0, -65.0, -15.0)
DEPTHS = (0.0, 800.0)
MAGNITUDES = (-2.0, 10.5)


def catalogue_pages(now: Column, days: int = 2) -> Column:
    """Paths of a catalogue's pages of the last days, newest first: a page is a day of the clocks of America/Santiago."""
    today = F.to_date(F.from_utc_timestamp(now, "America/Santiago"))
    path = lambda back: F.date_format(F.date_sub(today, back.cast("int")), "'sismicidad/catalogo/'yyyy/MM/yyyyMMdd'.html'")
    return F.transform(F.sequence(F.lit(0), F.lit(days - 1)), path)


def _catalogue_row(row: Column, pos: Column, root: str) -> Column:
    """The fields of a catalogue's row, each part of it worked out once; null without five cells or a numbered report.

    White space of cells is collapsed before times are read, so that only a T can be more than one space.
    """
    # nullif() would work out twice what it is given; times and numbers of empty text are null anyway.
    known = lambda value: text.once(value, lambda x: F.nullif(x, F.lit("")))
    spaced = lambda said: F.when(F.contains(said, F.lit("T")), F.regexp_replace(said, r"[\sT]+", " ")).otherwise(said)
    time_ = lambda cell: F.try_to_timestamp(text.once(F.regexp_extract(cell, r"(\d{4}-\d{2}-\d{2}[\sT]+\d{2}:\d{2}(?::\d{2})?)", 1), spaced))
    within = lambda value, low, high: text.once(value, lambda x: F.when(x.between(low, high), x))
    anchor = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']\s*([^\"']*?)\s*[\"'][^>]*>(.*?)</a>"
    size = r"(?i)(-?\d+(?:\.\d+)?)\s*(M[a-z]*)?"

    def numbered(raw: Column) -> Column:
        first = F.get(raw, F.lit(0))
        return text.once(F.regexp_extract(first, anchor, 1), lambda link: text.once(F.regexp_extract(link, r"(?i)/(\d+)\.html?$", 1), lambda report: F.when(report != "", told(raw, first, link, report))))

    def told(raw: Column, first: Column, link: Column, report: Column) -> Column:
        place = text.strip_html(F.regexp_replace(first, r"(?is)<a\b[^>]*>.*?</a>", " "))
        url = F.when(link.rlike("^https?://") | (F.lit(root) == ""), link).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.ltrim(link, F.lit("/"))))
        local = F.to_utc_timestamp(time_(text.strip_html(first)), "America/Santiago")
        return text.once(F.transform(F.slice(raw, 2, 4), text.strip_html), lambda c: text.once(parts(c), lambda p: F.struct(
            pos.alias("pos"), report.alias("report"), F.coalesce(p["utc"], local).alias("ts"), F.when(p["utc"].isNotNull(), "utc_column").otherwise("local_column").alias("time_source"),
            F.get(p["spot"], F.lit(0)).alias("lat"), F.get(p["spot"], F.lit(1)).alias("lon"), p["depth_km"].alias("depth_km"), p["magnitude"].alias("magnitude"),
            F.when(p["magnitude"].isNotNull(), known(F.regexp_extract(F.get(c, F.lit(3)), size, 2))).alias("mag_type"), known(place).alias("place"), url.alias("report_url"),
        )))

    def parts(c: Column) -> Column:
        at = lambda k: F.get(c, F.lit(k - 1))
        depth, magnitude = F.regexp_extract(at(3), r"(?i)(-?\d+(?:\.\d+)?)\s*km", 1), F.regexp_extract(at(4), size, 1)
        return F.struct(
            time_(at(1)).alias("utc"), F.transform(F.regexp_extract_all(at(2), F.lit(r"(-?\d+\.\d+)"), F.lit(1)), lambda x: x.cast("double")).alias("spot"),
            within(depth.try_cast("double"), *DEPTHS).alias("depth_km"), within(magnitude.try_cast("double"), *MAGNITUDES).alias("magnitude"),
        )

    return text.once(F.regexp_extract_all(row, F.lit(r"(?s)<[tT][dDhH](?![\w\p{L}\p{Nd}])[^>]*>(.*?)</[tT][dDhH]>"), F.lit(1)), lambda raw: F.when(F.size(raw) >= 5, numbered(raw)))


def quake_table(df: DataFrame, box: tuple = P.SEISMIC_BOX, root: str = "") -> DataFrame:
    """Quakes of an HTML catalogue: rows of five cells and more (local time and place, UTC time, coordinates, depth, magnitude), one a report.

    Without a UTC time, the local one counts as of America/Santiago; raw says which it was. A depth or magnitude out of
    range is unknown; a row out of the country, without a time or without a numbered report is left out. Of rows of one
    report, also on several pages, the first counts. A page without a table is an error. root makes links whole.
    """
    table = F.lower("payload").contains("<table")
    found = F.regexp_extract_all("payload", F.lit(r"(?s)<[tT][rR][^>]*>(.*?)</[tT][rR]>"), F.lit(1))
    # Rows are read inside the generator: a filter after it cannot be pushed before it, which would read each row again for each condition.
    read = F.transform(F.when(table, found).otherwise(F.raise_error("no table of quakes")), lambda row, pos: _catalogue_row(row, pos, root))
    rows = df.where("payload IS NOT NULL").select(F.xxhash64("payload").alias("page"), F.inline(F.filter(read, lambda r: r.isNotNull())))
    rows = rows.where("ts IS NOT NULL").where(F.expr(geo.in_box("lat", "lon", CATALOGUE_BOX)))
    fields = ("ts", "lat", "lon", "depth_km", "magnitude", "mag_type", "place", "report_url", "time_source")
    rows = rows.groupBy("report").agg(F.min(F.struct("pos", "page", *fields)).alias("_f")).select("report", *[f"_f.{c}" for c in fields])
    rows = rows.where(F.expr(geo.in_box("lat", "lon", box)))
    said = F.when(F.col("magnitude").isNull(), "Sismo de magnitud no determinada").otherwise(F.format_string("Sismo de magnitud %.1f", "magnitude"))
    raw = F.to_json(F.struct("magnitude", "mag_type", "depth_km", "place", "report_url", "time_source"))
    return signal(rows, "csn", ts=F.col("ts"), type=F.lit("earthquake"), lat=F.col("lat"), lon=F.col("lon"), text=said, external_id=F.concat(F.lit("csn:"), "report"), confidence=F.lit(1.0), raw=raw)


#: Names of the list in an outage answer, the likeliest first.
OUTAGE_LISTS = ("features", "data", "items", "results", "interrupciones", "cortes", "outages", "eventos")


def outages(df: DataFrame, provider: str, now: str) -> DataFrame:
    """Power cuts from JSON whose list stands alone, under a known name or under the one key there is; no list at all is an error.

    Keys are compared in lower case without space, dash and underscore; of equal ones the least with a value counts. A
    record may be a feature with a point and properties. Negative counts of clients are unknown. Times without a zone
    are of America/Santiago; a start that is missing or in the future is now.
    """
    v = df.withColumn("_v", F.try_parse_json("payload"))
    lists = F.coalesce(*[F.try_variant_get("_v", f"$.{n}", "array<map<string,string>>") for n in OUTAGE_LISTS])
    nested = F.element_at(F.map_values(F.try_variant_get("_v", "$", "map<string,array<map<string,string>>>")), 1)
    found = F.coalesce(F.try_variant_get("_v", "$", "array<map<string,string>>"), lists, nested)
    rows = v.select(F.explode(F.coalesce(found, F.raise_error(F.concat(F.lit("no list of outages: "), F.substring("payload", 1, 120))))).alias("m"))
    # Properties and point of a feature go before what stands beside them.
    bare = lambda k: F.regexp_replace(F.lower(k), r"[\s_-]", "")
    inner = lambda name, kind: F.from_json(F.get(F.filter(F.map_entries("m"), lambda e: e["key"] == name), F.lit(0))["value"], kind)
    entries = F.filter(F.concat(F.coalesce(F.map_entries(inner("properties", "map<string,string>")), F.array()), F.map_entries("m")), lambda e: ~F.coalesce(e["value"], F.lit("null")).isin("null", "None"))
    rows = rows.where("m IS NOT NULL").withColumns({"p": entries, "_xy": inner("geometry", "struct<coordinates:array<string>>")["coordinates"]})
    get = lambda *names: first_value(F.col("p"), bare, *names)
    present = F.lit(now).cast("timestamp")
    start = text.local_timestamp(get("horainicio", "fechainicio", "inicio", "starttime"))
    clients = get("clientesafectados", "clientes", "affectedclients", "afectados").try_cast("double").cast("long")
    x, y = (F.get("_xy", F.lit(k)).try_cast("double") for k in (0, 1))
    pointed = x.isNotNull() & y.isNotNull()
    lat, lon = get("lat", "latitud", "latitude", "y").try_cast("double"), get("lon", "lng", "longitud", "longitude", "x").try_cast("double")
    rows = rows.withColumns({"lat": F.when(pointed, y).otherwise(lat), "lon": F.when(pointed, x).otherwise(lon)})
    rows = rows.where(F.expr(geo.in_box("lat", "lon", P.REGION_BOX)))
    ident = F.coalesce(F.concat(F.lit(f"{provider}:"), get("id", "codigo", "folio", "outageid", "uuid")), text.external_id(provider, F.format_string("%.5f", "lat"), F.format_string("%.5f", "lon"), get("horainicio"), length=24))
    raw = F.to_json(F.struct(F.when(clients >= 0, clients).alias("clients"), text.local_timestamp(get("horareposicion", "fechareposicion", "eta")).alias("restoration"), get("sector").alias("sector")))
    return signal(rows, provider, ts=F.least(F.coalesce(start, present), present), type=F.lit("power_outage"), lat=F.col("lat"), lon=F.col("lon"), text=F.concat_ws(" ", F.lit("Corte de suministro"), get("comuna")), external_id=ident, confidence=F.lit(1.0), commune=get("comuna", "municipio"), raw=raw)


def traffic(df: DataFrame, now: str, oldest_min: int = 120) -> DataFrame:
    """Accidents of the community feed, not older than `oldest_min`; x is the longitude. A list that is no list is an error."""
    kind = "struct<alerts:array<struct<uuid:string,type:string,subtype:string,street:string,city:string,location:struct<x:double,y:double>,pubMillis:long>>>"
    wrong = F.try_parse_json("payload").isNull() | (F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), "$.alerts", "variant")).startswith("ARRAY") == F.lit(False))
    rows = df.withColumn("_p", F.from_json("payload", kind)).select(F.explode(F.when(wrong, F.raise_error("no list of alerts")).otherwise(F.col("_p.alerts"))).alias("a"))
    ts = F.timestamp_millis("a.pubMillis")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(ts)
    rows = rows.where((F.col("a.type") == "ACCIDENT") & F.col("a.location.y").between(-90, 90) & F.col("a.location.x").between(-180, 180) & (age <= oldest_min * 60))
    return signal(rows, "waze", ts=ts, type=F.lit("accident"), lat=F.col("a.location.y"), lon=F.col("a.location.x"), text=F.concat_ws(": ", F.lit("Accidente de tránsito"), F.concat_ws(" — ", "a.street", "a.city")), external_id=F.concat(F.lit("waze:"), "a.uuid"), confidence=F.lit(0.40), commune=F.nullif(F.trim(F.split("a.city", ",")[0]), F.lit("")), raw=F.to_json("a"))


def dispatches(df: DataFrame, now: str, codes: tuple[tuple[int, ...], ...] = ((10, 4),)) -> DataFrame:
    """Radio dispatches of a feed's items with one of the codes; they bring no place. A page that is no feed is an error."""
    feed = F.lower("payload").rlike(r"<(rss|feed|rdf)")
    items = F.regexp_extract_all("payload", F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    rows = df.select(F.explode(F.when(~feed, F.raise_error("no feed")).otherwise(items)).alias("item"))
    tag = lambda name: text.strip_html(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    rows = rows.withColumn("said", F.concat_ws(" ", F.array_distinct(F.filter(F.array(tag("title"), tag("summary"), tag("description")), lambda x: x != "")))).withColumn("_codes", text.radio_codes(F.col("said")))
    rows = rows.where(F.exists(F.array(*[F.array(*[F.lit(x) for x in c]) for c in codes]), lambda c: F.exists(F.col("_codes"), lambda g: F.slice(g, F.lit(1), F.size(c)) == c)))
    present = F.lit(now).cast("timestamp")
    when = F.coalesce(F.try_to_timestamp(F.regexp_extract(tag("pubDate"), r"\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}", 0), F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.nullif(tag("updated"), F.lit(""))), present)
    return signal(rows, "bomberos", ts=F.least(when, present), type=F.lit("dispatch"), text=F.col("said"), external_id=text.external_id("bomberos", F.coalesce(F.nullif(tag("guid"), F.lit("")), F.col("said"))), confidence=F.lit(1.0))


#: Words of a road accident.
ACCIDENT_WORDS = ("accidente", "colision", "choque", "atropello", "volcamiento", "siniestro")


class _Blocks(HTMLParser):
    """The texts of a page's article, li and p elements, each with what its inner elements say."""

    KINDS = ("article", "li", "p")

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, list[str]]] = []
        self.found: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.KINDS:
            if tag == "p" and self.open and self.open[-1][0] == "p":  # a paragraph ends where the next begins
                self.handle_endtag("p")
            self.open.append((tag, []))
        self.hidden += tag in ("script", "style")
        self.handle_data(" ")

    def handle_endtag(self, tag) -> None:
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in [t for t, _ in self.open]:
            while self.open:
                kind, said = self.open.pop()
                self.found.append("".join(said))
                if kind == tag:
                    break
        self.handle_data(" ")

    def handle_data(self, data) -> None:
        if not self.hidden:
            for _, said in self.open:
                said.append(data)


def _page_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page in batch.column("payload").to_pylist():
            parser = _Blocks()
            parser.feed(page or "")
            parser.close()
            out.append([*parser.found, *("".join(said) for _, said in parser.open)])
        yield pa.RecordBatch.from_pydict({"blocks": pa.array(out, pa.list_(pa.string()))})


def notices(df: DataFrame, now: str, gazetteer: DataFrame | None = None) -> DataFrame:
    """Accidents told in the blocks of a page, 25 to 1200 letters long; of blocks that hold one another, the innermost.

    gazetteer (street, lat, lon) gives a place to notices whose first street, told from the city, it knows, in the stead
    of a geocoder.
    """
    blocks = F.array_distinct(F.transform("blocks", lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))
    told = lambda x: F.length(x).between(25, 1200) & F.exists(F.array(*[F.lit(w) for w in ACCIDENT_WORDS]), lambda w: F.contains(F.translate(F.lower(x), "áéíóú", "aeiou"), w))
    rows = df.select("payload").mapInArrow(_page_blocks, "blocks array<string>").select(F.filter(blocks, told).alias("b"))
    rows = rows.select(F.explode(F.filter("b", lambda x: ~F.exists("b", lambda y: (x != y) & F.contains(x, y)))).alias("said")).distinct()
    rows = rows.withColumn("_plain", F.expr(cases.plain_text("said")))
    rows = rows.withColumn("street", F.lower(text.address(F.col("said"))["street_1"]))
    if gazetteer is not None:
        rows = rows.join(gazetteer.select(F.lower("street").alias("street"), "lat", "lon"), "street", "left")
    else:
        rows = rows.withColumns({"lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    return signal(rows, "transporte_informa", ts=F.lit(now).cast("timestamp"), type=F.lit("accident"), lat=F.col("lat"), lon=F.col("lon"), text=F.col("said"), external_id=text.external_id("mtt", F.col("_plain"), length=24), confidence=F.lit(0.80))


ATTEMPTS = "source string, ok boolean, rows long, error string"


def _tried(name: str, read) -> tuple[DataFrame | None, tuple, Exception | None]:
    """A reader's rows as a written table, so that all of its pages are known to be good; or its error."""
    try:
        df = materialise(read(), "answer")
        n = df.count()
        if not n:
            warnings.warn(f"{name} answered without rows", stacklevel=3)
        return df, (name, True, n, None), None
    except Exception as e:  # noqa: BLE001
        return None, (name, False, 0, str(e).splitlines()[0][:300]), e


def first_that_answers(spark, readers: dict) -> tuple[DataFrame, DataFrame]:
    """Of named readers (callables), the rows of the first that gives all of them without failing, and ATTEMPTS.

    No rows are an answer, with a warning. If all fail, the last error is raised.
    """
    attempts, error = [], ValueError("no readers")
    for name, read in readers.items():
        df, attempt, failed = _tried(name, read)
        attempts.append(attempt)
        if df is not None:
            return df, spark.createDataFrame(attempts, ATTEMPTS)
        error = failed
    raise error


def union_of(spark, readers: dict) -> tuple[DataFrame, DataFrame]:
    """The rows of all named readers that answer, columns by name with nulls for missing ones, and ATTEMPTS; an error only if all fail."""
    found, attempts, error = [], [], ValueError("no readers")
    for name, read in readers.items():
        df, attempt, failed = _tried(name, read)
        attempts.append(attempt)
        found += [df] if df is not None else []
        error = failed or error
    if not found:
        raise error
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), spark.createDataFrame(attempts, ATTEMPTS)


def winds(df: DataFrame) -> DataFrame:
    """(wind_speed, wind_direction, observed_at) of weather payloads; no row where speed or direction is no number, negative or off the compass."""
    v = F.try_parse_json("payload")
    number = lambda k: F.when(~F.schema_of_variant(F.try_variant_get(v, f"$.current_weather.{k}", "variant")).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(v, f"$.current_weather.{k}", "double"))
    time_ = F.when(F.schema_of_variant(F.try_variant_get(v, "$.current_weather.time", "variant")) == "STRING", F.try_variant_get(v, "$.current_weather.time", "string"))
    rows = df.select(*df.columns, number("windspeed").alias("wind_speed"), number("winddirection").alias("wind_direction"), time_.alias("observed_at"))
    return rows.where("wind_speed >= 0 AND wind_speed < double('infinity') AND wind_direction BETWEEN 0 AND 360").drop("payload")
