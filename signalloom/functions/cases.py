"""Lookups and labels as expressions that Spark and ANSI SQL read alike."""

from __future__ import annotations

from signalloom import policy as P


def quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else ("TRUE" if x is True else "FALSE" if x is False else f"{float(x)!r}e0" if isinstance(x, float) else str(x))


def case(column: str, table: dict, otherwise=None) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {quoted(otherwise)} END"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def incident_type(column: str) -> str:
    return case(column, P.INCIDENT_TYPE)


def family(column: str) -> str:
    """Family of an event type; unmapped types are `other`."""
    return case(column, {k: P.FAMILY[v] for k, v in P.INCIDENT_TYPE.items()}, "other")


def incident_family(column: str) -> str:
    return case(column, P.FAMILY, "other")


def rule(column: str, field: str) -> str:
    """A field of the source's scoring rule."""
    number = lambda v: bool(v) if isinstance(v, bool) else float(v)
    return case(column, {s: number(getattr(r, field)) for s, r in P.RULES.items()}, number(getattr(P.DEFAULT_RULE, field)))


def baseline(column: str) -> str:
    return case(column, {k: float(v) for k, v in P.BASELINE.items()}, P.UNKNOWN_BASELINE)


def level(column: str) -> str:
    """unsafe below 0.30, confirmed above 0.60, both borders possible."""
    return f"CASE WHEN {column} IS NULL THEN NULL WHEN {column} < {P.UNSAFE_BELOW}e0 THEN 'unsafe' WHEN {column} > {P.CONFIRMED_ABOVE}e0 THEN 'confirmed' ELSE 'possible' END"


def confidence_label(column: str) -> str:
    return f"CASE WHEN {column} >= 0.95e0 THEN 'Confirmado' WHEN {column} >= 0.75e0 THEN 'Alta' WHEN {column} >= 0.5e0 THEN 'Media' ELSE 'Baja' END"


def title(type_column: str, commune: str) -> str:
    base = case(type_column, P.TITLES, "Emergencia")
    return f"CASE WHEN {commune} IS NULL OR {commune} = '' THEN {base} ELSE {base} || ' — ' || {commune} END"


def plain(column: str) -> str:
    """Lower-cased text without the accents of Latin letters, white space collapsed and trimmed."""
    accented, bare = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
    return f"trim(regexp_replace(translate(lower({column}), '{accented}', '{bare}'), '[ \\t\\n\\r]+', ' '{{g}}))"


def plain_text(column: str, spark: bool = True) -> str:
    """plain() in Spark's SQL or, with a g flag, in DuckDB's."""
    text = plain(column).replace("{g}", "" if spark else ", 'g'")
    return text.replace("\\", "\\\\") if spark else text


def magnitude_band(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'unknown' WHEN {column} > 5.5e0 THEN 'strong' WHEN {column} >= 4e0 THEN 'moderate' ELSE 'minor' END"


def ago(seconds: str, text: str) -> str:
    """How long ago, in words; text is the dialect's string type."""
    whole = lambda n: f"CAST(CAST(floor(({seconds}) / {n}e0) AS BIGINT) AS {text})"
    return f"CASE WHEN {seconds} < 60 THEN 'hace instantes' WHEN {seconds} < 3600 THEN 'hace ' || {whole(60)} || ' min' WHEN {seconds} < 86400 THEN 'hace ' || {whole(3600)} || ' h' ELSE 'hace ' || {whole(86400)} || ' d' END"


def percent(column: str, text: str) -> str:
    """A share as a whole percentage, rounded down."""
    return f"CAST(CAST(floor(CAST({column} AS DOUBLE) * 1e2) AS INT) AS {text}) || '%'"


def closed(status: str) -> str:
    """Closed for a map's reader: under control counts."""
    return f"{status} NOT IN ('active')"


def marker(level_column: str) -> str:
    """Size factor of a marker by level of confidence."""
    return f"CASE {level_column} WHEN 'confirmed' THEN 1e0 WHEN 'possible' THEN 0.78e0 ELSE 0.58e0 END"
