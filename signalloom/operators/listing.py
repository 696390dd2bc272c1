"""Filters, listings and statistics over signals and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases, geo


def at_least(column: str, value: float) -> Column:
    """Comparison that a 4-byte float passes at the border; the column stays bare, so that it reaches the scan."""
    return F.col(column) >= value - P.EPSILON


def at_most(column: str, value: float) -> Column:
    return F.col(column) <= value + P.EPSILON


def in_box(box: tuple[float, float, float, float]) -> Column:
    return F.expr(geo.in_box("lat", "lon", box))


def within(df: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows in a radius, with distance_m: a box that reaches the scan, then the distance."""
    boxed = df.where(in_box(geo.around(lat, lon, metres)))
    return geo.with_spheroid(boxed, "distance_m", F.lit(lat), F.lit(lon), "lat", "lon").where(F.col("distance_m") <= metres)


def filter_events(df: DataFrame, since=None, until=None, sources=(), types=(), least=None, box=None, near=None) -> DataFrame:
    """Signals that meet all given conditions; both ends of the time range count."""
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since))
    if until is not None:
        df = df.where(F.col("ts") <= F.lit(until))
    if sources:
        df = df.where(F.col("source").isin(*sources))
    if types:
        df = df.where(F.col("type").isin(*types))
    if least is not None:
        df = df.where(at_least("confidence", least))
    if box:
        df = df.where(in_box(box))
    if near:
        df = within(df, *near).drop("distance_m")
    return df


def neighbours_of(df: DataFrame, lat: float, lon: float, at: Column, metres: float = 2000.0, minutes: float = 60, own: int | None = None) -> DataFrame:
    """Signals around one place and time, with distance_m, without the signal `own`."""
    span = F.make_dt_interval(mins=F.lit(int(minutes)))
    found = within(df.where(F.col("ts").between(at - span, at + span)), lat, lon, metres)
    return found if own is None else found.where(F.col("id") != own)


def visible(df: DataFrame, layers: tuple[str, ...], providers: tuple[str, ...], known: tuple[str, ...] = ("chilquinta", "cge")) -> DataFrame:
    """Signals of the layers shown; outages of a known provider only if it is shown, of unknown ones always."""
    hidden = (F.col("type") == "power_outage") & F.col("source").isin(*known) & ~F.col("source").isin(*providers)
    return df.where(F.expr(cases.family("type")).isin(*layers) & ~hidden)


def list_events(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, then by id."""
    return df.orderBy(F.col("ts").desc(), "id").offset(offset).limit(min(limit, 1000))


def filter_incidents(df: DataFrame, since=None, statuses=P.OPEN_STATUSES, types=(), least=None, commune=None, confirmed=None, alerted=None, box=None) -> DataFrame:
    if since is not None:
        df = df.where(F.col("last_seen_at") >= F.lit(since))
    if statuses:
        df = df.where(F.col("status").isin(*statuses))
    if types:
        df = df.where(F.col("type").isin(*types))
    if least is not None:
        df = df.where(at_least("confidence", least))
    if commune:
        df = df.where(F.col("commune").ilike(f"%{commune}%"))
    if confirmed is not None:
        df = df.where(F.col("is_official_confirmed") == confirmed)
    if alerted is not None:
        df = df.where(F.col("alert_level").isNotNull() == F.lit(alerted))
    return df.where(in_box(box)) if box else df


def list_incidents(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return df.orderBy(F.col("is_official_confirmed").desc(), F.col("confidence").desc(), F.col("last_seen_at").desc(), "incident_id").offset(offset).limit(min(limit, 1000))


def event_stats(df: DataFrame) -> DataFrame:
    """One row a group of (all, source, type), from one pass: total, located, first and last time."""
    sets = df.groupingSets([[], ["source"], ["type"]], "source", "type")
    return sets.agg(F.count(F.lit(1)).alias("total"), F.count("lat").alias("located"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def daily_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy(F.date_trunc("day", "ts").alias("day"), "source", "type").agg(
        F.count(F.lit(1)).alias("events"), F.count("lat").alias("located"), F.round(F.avg("confidence"), 3).alias("avg_confidence")
    )


def incident_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_official_confirmed")).alias("confirmed"),
        F.count_if(F.col("alert_level").isNotNull()).alias("alerted"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def seismic_listing(df: DataFrame, provider: str = "usgs", least=None, deepest=None, tsunami=None, box=None, limit: int = 100) -> DataFrame:
    """Quakes of one provider, the largest first; a null magnitude or depth fails its bound."""
    df = df.where((F.col("source") == provider) & (F.col("type") == "earthquake"))
    if least is not None:
        df = df.where(F.col("magnitude") >= least)
    if deepest is not None:
        df = df.where(F.col("depth_km") <= deepest)
    if tsunami is not None:
        df = df.where(F.col("tsunami") == tsunami)
    if box:
        df = df.where(in_box(box))
    return df.orderBy(F.col("magnitude").desc_nulls_last(), F.col("ts").desc(), "id").limit(limit)


def seismic_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("quakes"), F.max("magnitude").alias("max_magnitude"), F.count_if(F.col("felt") > 0).alias("felt"), F.count_if("tsunami").alias("tsunami"))


def relevant(df: DataFrame, micro: bool = False) -> DataFrame:
    """Quakes of magnitude 4 and more, or of unknown magnitude; with micro, the others."""
    keep = F.coalesce(F.col("magnitude") >= 4, F.lit(True))
    return df.where(~keep if micro else keep)


def outage_pins(df: DataFrame, chosen: int | None = None, most: int = 150) -> DataFrame:
    """The outages with most clients; a chosen one that falls outside takes the last place."""
    rows = df.where("type = 'power_outage'")
    top = rows.orderBy(F.coalesce("clients", F.lit(0)).desc(), "id").limit(most)
    if chosen is None:
        return top
    short = rows.where(F.col("id") != chosen).orderBy(F.coalesce("clients", F.lit(0)).desc(), "id").limit(most - 1)
    return short.unionByName(rows.where(F.col("id") == chosen))


def with_reading(df: DataFrame) -> DataFrame:
    """Columns that readers expect: has_location, in_region, family, level, label."""
    return df.withColumns({
        "has_location": F.col("lat").isNotNull() & F.col("lon").isNotNull(),
        "in_region": F.coalesce(in_box(P.REGION_BOX), F.lit(False)),
        "family": F.expr(cases.family("type")),
        "confidence_level": F.expr(cases.level("confidence")),
        "confidence_label": F.expr(cases.confidence_label("confidence")),
    })


def to_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """A GeoJSON feature a row, as `feature`; rows without a place have a null geometry."""
    point = F.when(F.col("lat").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")))
    return df.withColumn("feature", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}))


def _polygon(df: DataFrame, ring: Column, properties: list[str]) -> DataFrame:
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return df.withColumn("feature", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}))


def reach_features(quakes: DataFrame) -> DataFrame:
    """A polygon feature for each quake that can be felt somewhere; the others are left out."""
    rows = quakes.withColumn("_km", F.expr(geo.perception_radius("magnitude", "depth_km"))).where("_km IS NOT NULL").withColumn("radius_km", F.round("_km").cast("long"))
    return _polygon(rows, geo.circle_ring("lat", "lon", "_km * 1e3"), ["id", "radius_km", "magnitude"]).drop("_km")


def cone_features(incidents: DataFrame) -> DataFrame:
    """A wedge feature downwind of each incident with a wind (wind_speed, wind_direction); the others are left out."""
    cone = geo.wind_cone("wind_speed", "wind_direction")
    rows = incidents.withColumns({f"_{k}": F.expr(v) for k, v in cone.items()}).where("_bearing IS NOT NULL AND lat IS NOT NULL")
    rows = rows.withColumns({"bearing_deg": F.round("_bearing").cast("long"), "length_km": F.round("_length_km", 1)})
    return _polygon(rows, geo.sector_ring("lat", "lon", "_bearing", "_half_angle", "_length_km * 1e3"), ["code", "bearing_deg", "length_km"]).drop(*[f"_{k}" for k in cone])


def box_of(text: Column) -> Column:
    """west,south,east,north of a text as a struct with `error`: null if good or blank, else shape, number or inverted. A bad box never means no box."""
    parts = F.split(text, ",")
    at = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("double")
    west, south, east, north = (at(k) for k in range(4))
    missing = west.isNull() | south.isNull() | east.isNull() | north.isNull()
    error = F.when(text.isNull() | (text == ""), None).when(F.size(parts) != 4, "shape").when(missing, "number").when((west >= east) | (south >= north), "inverted")
    return F.struct(west.alias("west"), south.alias("south"), east.alias("east"), north.alias("north"), error.alias("error"))


def near_of(lat: Column, lon: Column, metres: Column) -> Column:
    """Whether a radius filter is whole: null for none of its three values, true for all, false for some."""
    given = lat.isNotNull().cast("int") + lon.isNotNull().cast("int") + metres.isNotNull().cast("int")
    return F.when(given > 0, given == 3)


def ordered_links(links: DataFrame) -> DataFrame:
    """Links with `place` from 1 in their incident, by linked_at, then event."""
    return links.withColumn("place", F.row_number().over(Window.partitionBy("incident_id").orderBy("linked_at", "event_id")).cast("long"))


def with_levels(incidents: DataFrame) -> DataFrame:
    """Adds confidence_level."""
    return incidents.withColumn("confidence_level", F.expr(cases.level("confidence")))
