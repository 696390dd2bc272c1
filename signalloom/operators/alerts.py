"""Alerts without a place, matched to incidents by commune and family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom import policy as P
from signalloom.functions import cases


def _has_any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def split_communes(column: str) -> Column:
    """Names of a list written with commas, semicolons, strokes or a joining y or e."""
    parts = F.split(F.regexp_replace(column, r"\s[yYeE]\s", ","), r"[,;/|]")
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" .;\t\n"))), lambda x: x != "")


# Keys of a payload, in lower case, that name communes.
COMMUNE_KEYS = ("comuna", "nom_comuna", "comunas")


def with_commune(df: DataFrame) -> DataFrame:
    """Fills `commune` from the payload `raw` (JSON), then from the text after "Comuna:" or "Ubicación:"; the first of a list, never a whole area."""
    known = F.transform_keys(F.from_json("raw", "map<string,string>"), lambda k, _: F.lower(k))
    said = F.coalesce(*[F.nullif(F.trim(F.try_element_at(known, F.lit(k))), F.lit("")) for k in COMMUNE_KEYS])
    after = lambda lead: F.nullif(F.regexp_extract("text", rf"(?i){lead}\s*:\s*([^.]+)", 1), F.lit(""))
    rows = df.withColumns({"_known": said, "_c": after("comunas?"), "_u": after("ubicaci[oó]n")})
    rows = rows.withColumns({"_c": F.get(split_communes("_c"), F.lit(0)), "_u": F.get(split_communes("_u"), F.lit(0))})
    part = lambda c, found: F.when(~_has_any(F.expr(cases.plain_text(c)), P.WHOLE_AREA_WORDS), found)
    own = F.nullif(F.trim("commune"), F.lit(""))
    filled = F.coalesce(own, part("_known", F.get(split_communes("_known"), F.lit(0))), part("_c", F.col("_c")), part("_u", F.col("_u")))
    return rows.withColumn("commune", filled).drop("_known", "_c", "_u")


def alert_views(alerts: DataFrame) -> DataFrame:
    """(alert_id, communes, regional, level, family) of signals that are alerts."""
    text = F.expr(cases.plain_text("text"))
    family = F.lit("unknown")
    for name in reversed(list(P.FAMILY_WORDS)):
        family = F.when(_has_any(F.col("_t"), P.FAMILY_WORDS[name]), name).otherwise(family)
    level = F.lit("otra")
    for word, said in reversed(P.LEVEL_WORDS):
        level = F.when(F.contains(F.col("_t"), F.lit(word)), said).otherwise(level)
    out = alerts.withColumn("_t", text).withColumn("family", family).withColumn("level", level).withColumn("regional", _has_any(F.col("_t"), P.WHOLE_AREA_WORDS))
    return out.select(F.col("id").alias("alert_id"), split_communes("commune").alias("communes"), "regional", "level", "family")


def vigent_alerts(signals: DataFrame, since) -> DataFrame:
    """Alerts without a place, of sources that alert, refreshed since."""
    return signals.where(F.col("lat").isNull() & F.col("type").isin("alert", "evacuation") & F.col("source").isin("senapred", "municipality") & (F.col("updated_at") >= F.lit(since)))


def held_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(p, q): distinct names of left (p) and right (q) that are equal, or of which one holds the other, p of LEAST_CONTAINED letters or more.

    A name that lies in another lies there with its first letters: the pieces of the longer name, of as many letters
    or of all letters of a shorter name, meet these by a hash join, and the names are then compared.
    """
    n = P.LEAST_CONTAINED

    def pieces(c: str, sizes: list[int]):
        cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - k + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(k)))
        return F.array_distinct(F.flatten(F.array(*[cut(k) for k in sizes])))

    left, right = left.where("p <> ''"), right.where("q <> ''")
    long = left.where(F.length("p") >= n)
    p_in_q = long.withColumn("k", F.substring("p", 1, n)).join(right.withColumn("k", F.explode(pieces("q", [n]))), "k")
    q_in_p = long.withColumn("k", F.explode(pieces("p", list(range(1, n + 1))))).join(right.withColumn("k", F.substring("q", 1, n)), "k")
    held = p_in_q.union(q_in_p).where(F.contains(F.col("q"), F.col("p")) | F.contains(F.col("p"), F.col("q"))).select("p", "q")
    return held.union(left.join(right, F.col("p") == F.col("q")).select("p", "q")).distinct()


def match_alerts(alerts: DataFrame, incidents: DataFrame, regional: bool = False) -> DataFrame:
    """(alert_id, incident_id, matched_commune, link_confidence): text links, one a pair, by its best commune.

    Names match if equal without accents and case, or if one holds the other and the alert's name has five letters
    or more (held_names). An alert of unknown family fits any incident, for less. With `regional`, an alert of a whole
    area is linked to every incident that it fits: as many rows as there are such pairs, by what it means.
    """
    views = alert_views(alerts)
    fits = lambda: (F.col("a.family") == "unknown") | (F.col("a.family") == F.col("i.family"))
    plain = F.expr(cases.plain_text("name"))
    named = views.where(~F.col("regional")).select("alert_id", "family", F.posexplode("communes").alias("pos", "name")).withColumn("plain", plain)
    placed = incidents.where("commune IS NOT NULL AND commune <> ''").withColumn("name", F.col("commune")).withColumn("plain", plain)
    names = held_names(named.select(F.col("plain").alias("p")).distinct(), placed.select(F.col("plain").alias("q")).distinct())
    names = names.withColumn("weight", F.when(F.col("p") == F.col("q"), P.LINK_EXACT).otherwise(P.LINK_CONTAINED))
    pairs = named.alias("a").join(names, F.col("a.plain") == F.col("p")).join(placed.alias("i"), (F.col("q") == F.col("i.plain")) & fits())
    best = pairs.groupBy(F.col("a.alert_id").alias("alert_id"), F.col("i.incident_id").alias("incident_id")).agg(
        F.max_by(F.struct(F.col("a.name").alias("n"), F.col("weight").alias("w"), F.col("a.family").alias("f")), F.struct(F.col("weight"), -F.col("a.pos"))).alias("b")
    )
    weight = F.col("b.w") - F.when(F.col("b.f") == "unknown", P.UNKNOWN_FAMILY_LESS).otherwise(0.0)
    found = best.select("alert_id", "incident_id", F.col("b.n").alias("matched_commune"), F.round(weight, 4).alias("link_confidence"))
    if regional:
        wide = views.where("regional").alias("a").join(placed.alias("i"), fits())
        found = found.unionByName(wide.select("a.alert_id", "i.incident_id", F.col("i.commune").alias("matched_commune"), F.lit(P.LINK_REGIONAL).alias("link_confidence")))
    return found


def rebuild_text_links(links: DataFrame, matches: DataFrame) -> DataFrame:
    """All links with the text ones replaced by the matches."""
    text = matches.select("incident_id", F.col("alert_id").alias("event_id"), F.lit("commune_text").alias("link_method"), "link_confidence", F.lit(None).cast("double").alias("distance_m"), "matched_commune")
    return links.where("link_method <> 'commune_text'").unionByName(text, allowMissingColumns=True)


