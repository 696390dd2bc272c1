"""Vocabulary and thresholds of signal fusion, stated as plain tables."""

from __future__ import annotations

from dataclasses import dataclass

# Sources, in the order the adapter deals them.
SOURCES = (
    "nasa_firms", "conaf", "bomberos", "senapred", "usgs", "csn", "chilquinta", "cge", "municipality",
    "transporte_informa", "media", "broadcastify", "citizen", "camera", "social_media", "waze", "weather", "other",
)

# Baseline confidence of a signal that brings none.
BASELINE = {
    "bomberos": 1.0, "senapred": 1.0, "conaf": 1.0, "usgs": 1.0, "csn": 1.0, "chilquinta": 1.0, "cge": 1.0,
    "municipality": 0.90, "transporte_informa": 0.80, "media": 0.70, "broadcastify": 0.65, "nasa_firms": 0.55,
    "citizen": 0.50, "camera": 0.50, "social_media": 0.45, "waze": 0.40, "other": 0.30, "weather": 0.10,
}
UNKNOWN_BASELINE = 0.5

# Incident type of each event type; types not named map to nothing.
INCIDENT_TYPE = {
    "smoke": "possible_fire", "thermal_anomaly": "possible_fire", "wildfire": "wildfire", "structural_fire": "structural_fire",
    "flood": "flood", "landslide": "landslide", "accident": "accident", "power_outage": "power_outage", "rescue": "rescue",
    "dispatch": "other", "other": "other", "unknown": "other",
}

# Family of each incident type.
FAMILY = {
    "possible_fire": "fire", "wildfire": "fire", "structural_fire": "fire", "flood": "hydro", "landslide": "hydro",
    "accident": "traffic", "power_outage": "power", "rescue": "other", "other": "other",
}
FAMILIES = ("fire", "hydro", "traffic", "power", "other")

NOT_CORRELATABLE = ("alert", "evacuation", "earthquake", "weather_observation")
OPEN_STATUSES = ("active", "controlled")
MUTABLE_STATUSES = ("active", "controlled", "stale")


@dataclass(frozen=True)
class Rule:
    """How a source's signals add up: weight range, decay by rank, cap; what it may declare."""

    least: float
    most: float
    decay: float
    ceiling: float
    confirming: bool = False
    dispatch: bool = False
    alerts: bool = False


# Scoring rules by source.
RULES = {
    "conaf": Rule(1, 1, 1, 1, confirming=True),
    "bomberos": Rule(1, 1, 1, 1, confirming=True, dispatch=True),
    "chilquinta": Rule(1, 1, 1, 1, confirming=True),
    "cge": Rule(1, 1, 1, 1, confirming=True),
    "senapred": Rule(0.85, 0.85, 0.5, 0.85, alerts=True),
    "broadcastify": Rule(0.60, 0.80, 0.4, 0.90, dispatch=True),
    "municipality": Rule(0.60, 0.80, 0.5, 0.90, dispatch=True),
    "media": Rule(0.40, 0.60, 0.5, 0.75),
    "nasa_firms": Rule(0.40, 0.40, 0.35, 0.55),
    "camera": Rule(0.35, 0.55, 0.5, 0.70),
    "transporte_informa": Rule(0.60, 0.80, 0.5, 0.90),
    "waze": Rule(0.40, 0.40, 0.40, 0.65),
    "citizen": Rule(0.25, 0.40, 0.45, 0.75),
    "social_media": Rule(0.20, 0.35, 0.5, 0.55),
    "other": Rule(0.15, 0.30, 0.5, 0.45),
    "weather": Rule(0, 0, 0, 0),
    "usgs": Rule(0, 0, 0, 0),
    "csn": Rule(0, 0, 0, 0),
}
DEFAULT_RULE = RULES["other"]
DISPATCH_TYPES = ("dispatch", "rescue")
DISPATCH_WEIGHT = 0.80
UNCONFIRMED_CEILING = 0.95

# Alert levels by severity; state words of a confirming source; titles by incident type.
SEVERITY = {"roja": 4, "amarilla": 3, "temprana_preventiva": 2, "verde": 1, "otra": 0}
STATE_WORDS = (("extinguido", "extinguished"), ("apagado", "extinguished"), ("controlado", "controlled"), ("combate", "active"), ("activo", "active"), ("en curso", "active"))
TITLES = {
    "possible_fire": "Posible incendio", "wildfire": "Incendio forestal", "structural_fire": "Incendio estructural", "flood": "Inundación",
    "landslide": "Remoción en masa", "accident": "Accidente", "power_outage": "Corte de suministro", "rescue": "Rescate", "other": "Emergencia",
}

# Words of an alert's text that tell its family, its level and an evacuation; words for a whole area.
FAMILY_WORDS = {
    "fire": ("incendio", "forestal", "fuego", "humo"),
    "hydro": ("inundacion", "crecida", "aluvion", "remocion", "deslizamiento", "lluvia", "marejada"),
}
LEVEL_WORDS = (("roja", "roja"), ("amarilla", "amarilla"), ("temprana preventiva", "temprana_preventiva"), ("preventiva", "temprana_preventiva"), ("verde", "verde"))
EVACUATION_WORDS = ("evacuacion", "evacuar", "desalojo")
WHOLE_AREA_WORDS = ("toda la region", "todas las comunas", "todo el pais", "region completa", "nivel nacional", "todo el territorio")

# Weight of a text link, least length of a name matched by inclusion.
LINK_EXACT, LINK_CONTAINED, LINK_REGIONAL, UNKNOWN_FAMILY_LESS, LEAST_CONTAINED = 0.70, 0.55, 0.35, 0.15, 5

# Levels of confidence and the tolerance of 4-byte floats.
UNSAFE_BELOW, CONFIRMED_ABOVE, EPSILON = 0.30, 0.60, 1e-6


@dataclass(frozen=True)
class Policy:
    """Tunables of a correlation pass; hours, metres, counts. most_events: how many free signals a pass takes, the most confident first; None for all."""

    radius_m: float = 1500.0
    window_h: float = 4
    match_window_h: float = 12
    most_events: int | None = None
    min_signals: int = 1
    stale_h: float = 12
    alert_valid_h: float = 24
    attach_regional: bool = False
    active_window_h: float = 48
    citizen_ttl_min: float = 5
    citizen_most: float = 0.40


# Boxes (west, south, east, north).
REGION_BOX = (-72.0, -33.8, -69.8, -32.0)
SEISMIC_BOX = (-73.0, -35.0, -69.0, -31.0)

# Communes that the adapter deals.
COMMUNES = ("Valparaíso", "Viña del Mar", "Quilpué", "Villa Alemana", "Concón", "Limache", "Olmué", "Quillota", "La Calera", "Casablanca")
STATES = ("En combate", "Controlado", "Extinguido", "Activo", "Sin información")
