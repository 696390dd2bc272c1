"""Distances, projection and derived shapes as expressions over degrees; texts that Spark and ANSI SQL read alike."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres.
RADIUS = 6371008.8
#: Metres: below every radius of curvature of the spheroid.
LEAST_RADIUS = 6335000.0


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle distance in metres."""
    half = lambda a, b: f"pow(sin(radians(({b}) - ({a})) / 2e0), 2e0)"
    inner = f"{half(lat1, lat2)} + cos(radians({lat1})) * cos(radians({lat2})) * {half(lon1, lon2)}"
    return f"2e0 * {RADIUS}e0 * asin(least(1e0, sqrt({inner})))"


def spheroid(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Distance in metres on the WGS84 spheroid, by the Andoyer-Lambert correction of the great circle: good to two parts in a hundred thousand."""
    a, f = 6378137.0, 1 / 298.257223563
    square = lambda fun, x: f"pow({fun}(radians({x})), 2e0)"
    mid, half, side = f"(({lat1}) + ({lat2})) / 2e0", f"(({lat1}) - ({lat2})) / 2e0", f"(({lon1}) - ({lon2})) / 2e0"
    s = f"({square('sin', half)} * {square('cos', side)} + {square('cos', mid)} * {square('sin', side)})"
    c = f"({square('cos', half)} * {square('cos', side)} + {square('sin', mid)} * {square('sin', side)})"
    arc = f"atan(sqrt({s} / {c}))"
    ratio = f"(3e0 * sqrt({s} * {c}) / {arc})"
    more = f"({ratio} - 1e0) / (2e0 * {c}) * {square('sin', mid)} * {square('cos', half)}"
    less = f"({ratio} + 1e0) / (2e0 * {s}) * {square('cos', mid)} * {square('sin', half)}"
    return f"CASE WHEN {s} <= 0e0 THEN 0e0 ELSE 2e0 * {arc} * {number(a)} * (1e0 + {number(f)} * ({more} - {less})) END"


def with_spheroid(df, out: str, lat1: str | Column, lon1: str | Column, lat2: str | Column, lon2: str | Column):
    """df with the distance of spheroid() between two places (columns or their names) as a column: each sine is worked out once, as a column of its own.

    Points opposite each other have no one shortest way; they count as half a meridian apart.
    """
    a, f, half_meridian = 6378137.0, 1 / 298.257223563, 20003931.4586
    square = lambda x: F.pow(F.sin(F.radians(x / 2)), F.lit(2))
    lat1, lon1, lat2, lon2 = (F.col(x) if isinstance(x, str) else x for x in (lat1, lon1, lat2, lon2))
    step = df.withColumns({"_p": square(lat1 - lat2), "_q": square(lon1 - lon2), "_m": square(lat1 + lat2)})
    p, q, m = F.col("_p"), F.col("_q"), F.col("_m")
    step = step.withColumns({"_u": p * (1 - q) + (1 - m) * q, "_v": (1 - p) * (1 - q) + m * q})
    u, v = F.col("_u"), F.col("_v")
    step = step.withColumn("_arc", F.when((u > 0) & (v > 0), F.atan(F.sqrt(F.try_divide(u, v)))))
    arc, ratio = F.col("_arc"), F.try_divide(3 * F.sqrt(u * v), F.col("_arc"))
    more = F.try_divide(ratio - 1, 2 * v) * m * (1 - p)
    less = F.try_divide(ratio + 1, 2 * u) * (1 - m) * p
    found = F.when(u <= 0, F.lit(0.0)).when(v <= 0, F.lit(half_meridian)).otherwise(2 * arc * a * (1 + f * (more - less)))
    return step.withColumn(out, found).drop("_p", "_q", "_m", "_u", "_v", "_arc")


def in_box(lat: str, lon: str, box: tuple[float, float, float, float]) -> str:
    west, south, east, north = box
    return f"({lon} BETWEEN {west}e0 AND {east}e0 AND {lat} BETWEEN {south}e0 AND {north}e0)"


def around(lat: float, lon: float, metres: float) -> tuple[float, float, float, float]:
    """Box that holds the circle: filters on it reach the scan."""
    up = math.degrees(metres / LEAST_RADIUS)
    limit = min(89.9, abs(lat) + up)
    side = math.degrees(metres / (LEAST_RADIUS * math.cos(math.radians(limit))))
    return lon - side, lat - up, lon + side, lat + up


def utm(lat: str, lon: str, zone: int = 19) -> tuple[str, str]:
    """Easting and northing in metres, southern hemisphere, by the transverse Mercator series on WGS84."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    phi = f"radians({lat})"
    n = f"({a}e0 / sqrt(1e0 - {e2!r}e0 * pow(sin({phi}), 2e0)))"
    t, c = f"pow(tan({phi}), 2e0)", f"({ep2!r}e0 * pow(cos({phi}), 2e0))"
    x = f"(cos({phi}) * radians({lon} - ({-183.0 + 6 * zone}e0)))"
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072]
    m = f"({a}e0 * ({arc[0]!r}e0 * {phi} - {arc[1]!r}e0 * sin(2e0 * {phi}) + {number(arc[2])} * sin(4e0 * {phi}) - {number(arc[3])} * sin(6e0 * {phi})))"
    east = f"{k0}e0 * {n} * ({x} + (1e0 - {t} + {c}) * pow({x}, 3e0) / 6e0 + (5e0 - 18e0 * {t} + {t} * {t} + 72e0 * {c} - 58e0 * {number(ep2)}) * pow({x}, 5e0) / 120e0) + 500000e0"
    north = f"{k0}e0 * ({m} + {n} * tan({phi}) * (pow({x}, 2e0) / 2e0 + (5e0 - {t} + 9e0 * {c} + 4e0 * {c} * {c}) * pow({x}, 4e0) / 24e0 + (61e0 - 58e0 * {t} + {t} * {t} + 600e0 * {c} - 330e0 * {number(ep2)}) * pow({x}, 6e0) / 720e0)) + 10000000e0"
    return east, north


def number(x: float) -> str:
    """A double literal in plain digits with an exponent mark."""
    text = repr(x)
    return text if "e" in text else f"{text}e0"


def destination(lat: str, lon: str, bearing: str, metres: str) -> tuple[str, str]:
    """Point reached from (lat, lon) along a bearing in degrees."""
    d = f"(({metres}) / {RADIUS}e0)"
    lat2 = f"asin(sin(radians({lat})) * cos({d}) + cos(radians({lat})) * sin({d}) * cos(radians({bearing})))"
    lon2 = f"radians({lon}) + atan2(sin(radians({bearing})) * sin({d}) * cos(radians({lat})), cos({d}) - sin(radians({lat})) * sin({lat2}))"
    return f"degrees({lat2})", f"degrees({lon2})"


def _points(lat: str, lon: str, metres: str, bearing, steps: int) -> Column:
    """Points [longitude, latitude] at the bearings that `bearing` (a text) gives for k from 0 to steps."""
    north, east = destination(lat, lon, bearing("CAST(k AS DOUBLE)"), metres)
    return F.expr(f"transform(sequence(0, {steps}), k -> array({east}, {north}))")


def circle_ring(lat: str, lon: str, metres: str, steps: int = 72) -> Column:
    """A closed ring of `steps` points and the first one again."""
    return _points(lat, lon, metres, lambda k: f"({k} % {steps}) * {360 / steps!r}e0", steps)


def sector_ring(lat: str, lon: str, bearing: str, half_angle: str, metres: str, steps: int = 24) -> Column:
    """The closed ring of a wedge: its origin, an arc of steps + 1 points about the bearing, its origin."""
    arc = _points(lat, lon, metres, lambda k: f"(({bearing}) - ({half_angle}) + 2e0 * ({half_angle}) * {k} / {steps}e0)", steps)
    origin = F.array(F.expr(f"array(CAST({lon} AS DOUBLE), CAST({lat} AS DOUBLE))"))
    return F.concat(origin, arc, origin)


def perception_radius(magnitude: str, depth: str) -> str:
    """Kilometres around the epicentre where a quake can be felt; null if under 1.5 km, at most 400."""
    reach = f"pow(1e1, (1.7e0 + 1.5e0 * ({magnitude}) - 2.5e0) / 3e0)"
    deep = f"abs(coalesce({depth}, 15e0))"
    square = f"({reach} * {reach} - {deep} * {deep})"
    return f"CASE WHEN {magnitude} IS NULL OR {square} <= 0e0 OR sqrt(greatest(0e0, {square})) < 1.5e0 THEN NULL ELSE least(400e0, sqrt(greatest(0e0, {square}))) END"


def wind_cone(speed: str, direction: str) -> dict[str, str]:
    """Smoke cone of a wind in km/h that blows from `direction`: bearing, length_km, half_angle; null without wind."""
    calm = f"{speed} IS NULL OR {direction} IS NULL OR {speed} <= 0e0"
    return {
        "bearing": f"CASE WHEN {calm} THEN NULL ELSE ({direction} + 180e0) % 360e0 END",
        "length_km": f"CASE WHEN {calm} THEN NULL ELSE least(25e0, greatest(0.8e0, 0.1e0 * {speed})) END",
        "half_angle": f"CASE WHEN {calm} THEN NULL ELSE least(45e0, greatest(12e0, 45e0 - 0.5e0 * {speed})) END",
    }


def compass(direction: str) -> str:
    """Eight points, from degrees."""
    points = ("N", "NE", "E", "SE", "S", "SO", "O", "NO")
    return "CASE CAST(floor(((" + direction + ") % 360e0 + 22.5e0) / 45e0) AS INT) % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(points)) + " END"
