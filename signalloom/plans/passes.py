"""One correlation pass over snapshots: cluster, attach or open, merge, link alerts, expire."""

from __future__ import annotations

import time
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import geo
from signalloom.operators import alerts, attach, cluster, lifecycle, score
from signalloom.operators.versions import Versions
from signalloom.tables import counted, materialise

INCIDENTS = """incident_id long, first_seen_at timestamp, last_seen_at timestamp, sources array<string>, commune string, province string,
 is_official_confirmed boolean, source_count long, event_count long, breakdown array<struct<source:string,contribution:double,signals:long>>, confidence double,
 type string, status string, resolved_at timestamp, lat double, lon double, alert_level string, title string, family string, code string, merged_into_id long"""
LINKS = "incident_id long, event_id long, link_method string, link_confidence double, distance_m double, matched_commune string"


@dataclass
class Pass:
    """Tables after a pass; changed: the signals that it gave an incident, whole rows."""

    signals: DataFrame
    incidents: DataFrame
    links: DataFrame
    changed: DataFrame
    metrics: dict[str, int]
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(incidents, links) before the first pass."""
    return spark.createDataFrame([], INCIDENTS), spark.createDataFrame([], LINKS)


def _refreshed(incidents: DataFrame, links: DataFrame, signals: DataFrame) -> DataFrame:
    """Incidents whose status may change, worked out anew from their signals; the others, and those without signals, as they are."""
    own = links.select("incident_id", F.col("event_id").alias("id")).distinct().join(signals.drop("incident_id"), "id")
    live = incidents.where(F.col("status").isin(*P.MUTABLE_STATUSES))
    new = score.refresh(own.join(live.select("incident_id"), "incident_id", "left_semi")).join(live.select("incident_id", "code", "merged_into_id"), "incident_id")
    names = incidents.columns
    return new.select(*names).unionByName(incidents.join(new.select("incident_id"), "incident_id", "left_anti").select(*names))


def _opened(targets: DataFrame, members: DataFrame, incidents: DataFrame, year: int, top: int) -> DataFrame:
    """Rows of new incidents: the times of their signals, the type that these support best by confidence summed, and the next folios of the year."""
    fresh = targets.where("created").select("cluster_id", "incident_id", F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    kinds = members.groupBy("cluster_id", "type").agg(F.sum("confidence").alias("_c")).groupBy("cluster_id").agg(F.max_by("type", F.struct("_c", "type")).alias("type"))
    seeds = members.groupBy("cluster_id", "family").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at")).join(kinds, "cluster_id")
    code = F.format_string(f"INC-{year}-%05d", F.col("incident_id") - F.lit(top) + F.lit(lifecycle.last_code(incidents, year)))
    rows = fresh.join(seeds, "cluster_id").withColumns({"status": F.lit("active"), "code": code})
    typed = {f.name: f.dataType for f in incidents.schema}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast(typed[c])).alias(c) for c in incidents.columns])


def correlate(signals: DataFrame, incidents: DataFrame, links: DataFrame, now: str, policy: P.Policy = P.Policy()) -> Pass:
    """signals need id, ts, source, type, lat, lon, confidence, text, commune, province, state, incident_id, updated_at.

    Clusters are attached in the order of their most confident signals, each meeting the incidents as those before it
    have left them (attach.in_order). The result does not depend on the order of rows.
    """
    began = time.monotonic()
    at = F.lit(now).cast("timestamp")
    back = lambda hours: at - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(round(hours % 1 * 60)))
    one = F.count(F.lit(1))
    free = signals.where(F.col("incident_id").isNull() & F.col("lat").isNotNull() & (F.col("ts") >= back(policy.window_h)) & ~F.col("type").isin(*P.NOT_CORRELATABLE))
    if policy.most_events is not None:  # the others stay free for later passes
        free = free.orderBy(F.col("confidence").desc(), "ts", "id").limit(policy.most_events)
    free, seen_free = counted(free.drop("incident_id"), "candidates", events_considered=one)
    members = materialise(cluster.clusters(free, policy.radius_m).join(free, "id"), "members")
    places = cluster.cluster_centroids(members).join(members.select("cluster_id", "family").distinct(), "cluster_id")
    judged = cluster.open_or_defer(members, policy.min_signals).join(places, "cluster_id").join(attach.cluster_order(members), "cluster_id")
    top = incidents.agg(F.coalesce(F.max("incident_id"), F.lit(0))).first()[0]
    attached = attach.in_order(judged, members, incidents, links, signals, policy.radius_m, back(policy.match_window_h), top)
    targets = attached.targets
    paired = geo.with_spheroid(members.join(targets, "cluster_id"), "_away", "lat2", "lon2", "lat", "lon")
    spatial = paired.select("incident_id", F.col("id").alias("event_id"), F.lit("spatial").alias("link_method"), F.lit(1.0).alias("link_confidence"), F.round("_away", 2).alias("distance_m"), F.lit(None).cast("string").alias("matched_commune"))
    spatial, seen_links = counted(spatial, "spatial", spatial_links=one)
    links = links.unionByName(spatial)
    opened = _opened(targets, members, incidents, int(now[:4]), top)
    made = targets.agg(F.count_if("created").alias("incidents_created"), one.alias("incidents_updated")).first().asDict()
    incidents = materialise(_refreshed(incidents.unionByName(opened), links, signals), "incidents")

    kept = materialise(cluster.survivors(cluster.merge_pairs(incidents, policy.radius_m, back(policy.match_window_h))), "survivors")
    gone = kept.where("incident_id <> kept_id").select("incident_id", "kept_id")
    merged = incidents.join(gone, "incident_id", "left").withColumn("status", F.when(F.col("kept_id").isNotNull(), "merged").otherwise(F.col("status"))).withColumn("merged_into_id", F.coalesce("kept_id", "merged_into_id"))
    eye = F.col("status").isin(*P.OPEN_STATUSES) & (F.col("last_seen_at") >= back(policy.active_window_h))
    merged, seen_merged = counted(merged, "merged", incidents_merged=F.count("kept_id"), open=F.count_if(eye), incidents_without_commune=F.count_if(eye & F.col("commune").isNull()))
    merged = merged.select(*incidents.columns)
    links = materialise(cluster.relink(links, kept).select(*links.columns), "links")

    due, seen_due = counted(alerts.vigent_alerts(signals, back(policy.alert_valid_h)), "alerts", alerts_considered=one)
    text_links = alerts.match_alerts(due, merged.where(eye), policy.attach_regional)
    # Without open incidents, earlier text links stay.
    relinked = alerts.rebuild_text_links(links, text_links).select(*links.columns) if seen_merged["open"] else links
    relinked, seen_text = counted(relinked, "links", alert_links=F.count_if(F.col("link_method") == "commune_text"))
    fresh = _refreshed(merged, relinked, signals).withColumn("_before", F.col("status"))
    turned = lambda s: F.count_if((F.col("status") == s) & (F.col("_before") != s))
    final, seen_final = counted(lifecycle.expire(fresh, at, policy), "incidents", incidents_stale=turned("stale"), incidents_dismissed=turned("dismissed"))
    final = final.drop("_before")

    pointer = relinked.where("link_method = 'spatial'").groupBy("event_id").agg(F.min("incident_id").alias("_incident"))
    stamped = F.col("processed_at") if "processed_at" in signals.columns else F.lit(None).cast("timestamp")
    pointed = signals.join(pointer, F.col("id") == F.col("event_id"), "left").withColumn("processed_at", F.when(F.col("_incident").isNotNull() & F.col("incident_id").isNull(), at).otherwise(stamped))
    pointed = pointed.withColumn("_moved", F.col("_incident").isNotNull() & ~F.col("incident_id").eqNullSafe(F.col("_incident"))).withColumn("incident_id", F.coalesce("_incident", "incident_id")).drop("_incident", "event_id")
    metrics = {
        **seen_free, "clusters": attached.clusters, **made, "clusters_deferred": attached.clusters - made["incidents_updated"], **seen_links, **seen_merged, **seen_due, **seen_text, **seen_final,
        "rounds": attached.rounds,
    }
    del metrics["open"]
    told = [] if metrics["clusters"] else ["no free signals with a place"]
    if metrics["alerts_considered"] and not metrics["alert_links"]:
        told.append("alerts without an incident")
    return Pass(pointed.drop("_moved"), final, relinked, pointed.where("_moved").drop("_moved"), metrics, told, round(time.monotonic() - began, 3))


def stored_pass(tables: Versions, now: str, policy: P.Policy = P.Policy(), lease_s: float = 600.0) -> Pass | None:
    """A pass over the tables signals, incidents and links of a store, committed as one version; None while another writer holds the lease.

    Of the signals only the buckets of those that got an incident are rewritten. If another writer commits meanwhile, or
    takes the lease over, the pass is refused as a whole with a Conflict.
    """
    with tables.lease(lease_s) as mine:
        if mine is None:
            warnings.warn("another pass is running: this one is skipped", stacklevel=2)
            return None
        base = tables.version()
        signals = tables.read("signals", base)
        if signals is None:
            raise ValueError("no signals are stored")
        if "processed_at" not in signals.columns:
            raise ValueError("stored signals need a column processed_at")
        done = correlate(signals, tables.read("incidents", base), tables.read("links", base), now, policy)
        tables.commit({"incidents": done.incidents, "links": done.links}, base, mine, {"signals": done.changed.select(*signals.columns)})
        return done


def first_pass(spark: SparkSession, signals: DataFrame, now: str, policy: P.Policy = P.Policy()) -> Pass:
    return correlate(signals, *empty(spark), now, policy)
