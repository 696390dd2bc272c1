"""Parsing of short texts: radio codes, streets, satellite times, magnitudes; all built-in expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that join the numbers of a radio code.
JOINERS = "-–—/."
# Abbreviations whose dot does not end a sentence.
ABBREVIATIONS = ("av", "avda", "gral", "pdte", "pje", "ptje", "sta", "sto", "dr", "cnel", "cap", "km", "psje")
# Words before a place, words that end it, words between the two streets of a crossing; without accents.
PLACE_WORDS = ("en", "sobre", "a la altura de", "frente a")
END_WORDS = ("transito", "se recomienda", "precaucion", "personal", "carabineros", "equipos")
CROSSING_WORDS = ("con", "esquina de", "esquina", "/", "y")


def radio_codes(text: Column) -> Column:
    """Radio codes of a text as arrays of numbers: chains of two or more numbers of one or two digits, a middle 0 left out.

    All joiners become dashes without blanks around them; what is neither digit nor dash, or two dashes, parts the
    chains. A longer number (a year, a house) spoils its whole chain. A null text gives null.
    """
    dashed = F.regexp_replace(F.translate(text, JOINERS, "-" * len(JOINERS)), r"\s*-\s*", "-")
    chains = F.transform(F.split(dashed, "[^0-9-]+|--+"), lambda c: F.split(F.btrim(c, F.lit("-")), "-"))
    codes = F.filter(chains, lambda c: (F.size(c) > 1) & F.forall(c, lambda x: F.length(x) <= 2))
    kept = F.transform(codes, lambda c: F.filter(c, lambda x, i: (i != 1) | (F.size(c) < 3) | (x.cast("int") != 0)))
    return F.transform(kept, lambda c: F.transform(c, lambda x: x.cast("int")))


def has_code(codes: Column, prefix: tuple[int, ...]) -> Column:
    """Whether a code begins with the prefix."""
    wanted = F.array(*[F.lit(x) for x in prefix])
    return F.exists(codes, lambda g: F.slice(g, 1, len(prefix)) == wanted)


def satellite_confidence(raw: Column) -> Column:
    """l, n, h or a percentage as a confidence; 0.5 for anything else."""
    percent = raw.try_cast("double") / 100
    named = F.when(raw == "l", 0.30).when(raw == "n", 0.55).when(raw == "h", 0.80)
    return F.coalesce(named, F.when(percent.isNotNull(), F.least(F.lit(0.85), F.greatest(F.lit(0.10), percent))), F.lit(0.5))


def acquisition_time(date: Column, clock: Column) -> Column:
    """UTC time of a date and HHMM without leading zeros; null if out of range."""
    padded = F.lpad(clock, 4, "0")
    hour, minute = F.substring(padded, 1, 2).try_cast("int"), F.substring(padded, 3, 2).try_cast("int")
    good = (F.length(clock) <= 4) & hour.between(0, 23) & minute.between(0, 59)
    return F.when(good, F.try_to_timestamp(F.concat(date.cast("string"), F.lit(" "), padded), F.lit("yyyy-MM-dd HHmm")))


def any_timestamp(raw: Column) -> Column:
    """Epoch milliseconds or seconds, ISO text or day-first text as a timestamp; null if none fits."""
    number = raw.try_cast("double")
    epoch = F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number))
    text = [F.try_to_timestamp(raw, F.lit(p)) for p in ("dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy", "dd/MM/yyyy")]
    return F.coalesce(epoch, F.try_to_timestamp(raw), *text)


def local_timestamp(raw: Column, zone: str = "America/Santiago") -> Column:
    """any_timestamp() of text that means the clocks of a zone unless it is a number or names its own zone.

    Of an hour that comes twice the first counts; an hour that the clocks leave out goes by the clock before the change.
    """
    read = any_timestamp(raw)
    own = raw.try_cast("double").isNotNull() | raw.rlike(r"(?i)(Z|[0-9]{2}:[0-9]{2}.*[+-][0-9]{2}:?[0-9]{2})\s*$")
    return F.when(own, read).otherwise(F.to_utc_timestamp(read, zone))


def client_ip(forwarded: Column, real: Column, peer: Column) -> Column:
    """The caller's address: the first of the forwarded list, else the real one, else the peer's, else a fixed word."""
    given = [F.nullif(F.trim(x), F.lit("")) for x in (F.split(forwarded, ",")[0], real, peer)]
    return F.coalesce(*given, F.lit("desconocida"))


def masked_ip(ip: Column) -> Column:
    """An address without its last parts: two of four, or all but three of a longer list with colons; other texts as they are."""
    six, four = F.split(ip, ":"), F.split(ip, r"\.")
    short = F.when(F.size(six) > 3, F.concat(F.array_join(F.slice(six, 1, 3), ":"), F.lit(":···"))).otherwise(ip)
    return F.when(F.contains(ip, F.lit(":")), short).when(F.size(four) == 4, F.concat(F.array_join(F.slice(four, 1, 2), "."), F.lit(".×.×"))).otherwise(ip)


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entity_names() -> str:
    """JSON of what named entities stand for, by the standard library's table, and numbers 128 to 159 as the web reads them."""
    named = {name: ch for name, ch in html5.items() if name.endswith(";")}
    numbers = {f"#{i}": bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160)}
    return json.dumps({k.rstrip(";"): v for k, v in named.items()} | numbers)


def unescape(html: Column) -> Column:
    """Text with its entities resolved once, named and numbered; an unknown name stays, a number that is no letter is U+FFFD."""
    pattern = F.lit(r"&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);")
    table = F.from_json(F.lit(_entity_names()), "map<string,string>")

    def meaning(name):
        hexed = F.lower(F.substring(name, 2, 1)) == "x"
        code = F.when(hexed, F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).cast("long")
        letter = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        said = F.decode(F.unhex(F.lpad(F.hex(F.when(letter, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        numbered = F.coalesce(F.try_element_at(table, F.concat(F.lit("#"), code.cast("string"))), said)
        return F.when(F.startswith(name, F.lit("#")), numbered).otherwise(F.coalesce(F.try_element_at(table, name), F.concat(F.lit("&"), name, F.lit(";"))))

    def joined(said):
        # A part that is no match, then what the match after it means: nothing is resolved twice.
        meant = F.transform(F.regexp_extract_all(said, pattern, F.lit(1)), meaning)
        return F.array_join(F.zip_with(F.split(said, pattern, -1), meant, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")

    return once(html, lambda said: F.when(F.contains(said, F.lit("&")), joined(said)).otherwise(said))


def strip_html(html: Column) -> Column:
    """Text between tags with entities resolved and white space, also that without a break, collapsed."""

    # Most texts have nothing to strip, and a look for it costs less than the replacements.
    spaced = lambda said: said.rlike("[^ -~]") | F.contains(said, F.lit("  "))

    def stripped(said):
        bare = F.regexp_replace(F.regexp_replace(said, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
        return once(unescape(bare), lambda x: F.when(spaced(x), F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))

    return once(html, lambda said: F.trim(F.when(said.rlike("[^ -%'-;=-~]") | F.contains(said, F.lit("  ")), stripped(said)).otherwise(said)))


def external_id(prefix: str, *parts: Column, length: int = 32) -> Column:
    """prefix and the first hex digits of a sha256 over the parts, joined by strokes, nulls as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(joined, 256), 1, length))


def _said_at(plain: Column, i: Column, phrases: tuple[str, ...]) -> Column:
    """How many words the first phrase has that stands at place i (from 0) of an array of words; null for none."""
    found = F.lit(None).cast("int")
    for phrase in reversed(phrases):
        words = phrase.split()
        found = F.when(F.slice(plain, i + 1, len(words)) == F.array(*[F.lit(w) for w in words]), len(words)).otherwise(found)
    return found


def _up_to_stop(word: Column) -> Column:
    """A word up to the dot or semicolon that ends its sentence; the dot of an abbreviation at its start ends none."""
    head = F.substring_index(word, ".", 1)
    short = F.lower(head).isin(*ABBREVIATIONS) & (F.length(head) < F.length(word))
    until = lambda x: F.substring_index(F.substring_index(x, ".", 1), ";", 1)
    return F.when(short, F.concat(head, F.lit("."), until(F.substring(word, F.length(head) + 2, F.length(word))))).otherwise(until(word))


def street_parts(text: Column) -> Column:
    """The place that a text names, as one street or the streets of a crossing; empty if it names none.

    A scan over the words: the place begins after the first of PLACE_WORDS, and ends with its sentence or before the
    first of END_WORDS; CROSSING_WORDS part it. A null text gives null.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    plain = lambda ws: F.transform(ws, lambda w: F.translate(F.btrim(F.lower(w), F.lit("¡!¿?\"'(),:;")), "áéíóú", "aeiou"))
    places = lambda ws: F.sequence(F.lit(0), F.size(ws))

    def after_lead(ws: Column, known: Column) -> Column:
        leads = F.filter(F.transform(places(ws), lambda i: F.struct(i.alias("at"), _said_at(known, i, PLACE_WORDS).alias("n"))), lambda x: x["n"].isNotNull())
        return once(F.get(leads, F.lit(0)), lambda first: F.when(first.isNotNull(), F.slice(ws, first["at"] + first["n"] + 1, F.size(ws))).otherwise(F.slice(ws, 1, 0)))

    def before_end(ws: Column, known: Column) -> Column:
        told = lambda i: (i > 0) & _said_at(known, i, END_WORDS).isNotNull()
        ends = F.filter(places(ws), lambda i: told(i) | (_up_to_stop(F.get(ws, i)) != F.get(ws, i)))

        def cut(at: Column) -> Column:
            last = F.when(told(at) | (at >= F.size(ws)), F.slice(ws, 1, 0)).otherwise(F.array(_up_to_stop(F.get(ws, at))))
            return F.concat(F.slice(ws, F.lit(1), at), last)

        return once(F.coalesce(F.get(ends, F.lit(0)), F.size(ws)), cut)

    def crossing(ws: Column, known: Column) -> Column:
        between = lambda i: _said_at(known, i, CROSSING_WORDS).isNotNull() | ((i > 0) & (F.coalesce(_said_at(known, i - 1, CROSSING_WORDS), F.lit(0)) > 1))
        return F.split(F.array_join(F.transform(ws, lambda w, i: F.when(between(i), "\n").otherwise(w)), " "), "\n")

    def with_plain(ws: Column, step) -> Column:
        return once(ws, lambda own: once(plain(own), lambda known: step(own, known)))

    parts = with_plain(with_plain(with_plain(words, after_lead), before_end), crossing)
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" ,"))), lambda x: x != "")


# Communes of the region that notices name, in plain letters.
CITIES = (
    "valparaiso", "vina del mar", "quilpue", "villa alemana", "concon", "casablanca", "quillota", "la calera", "san antonio", "cartagena",
    "el quisco", "algarrobo", "limache", "olmue", "los andes", "san felipe", "la ligua", "petorca", "quintero", "puchuncavi",
)


def _city_at_end(value: Column, cities: tuple[str, ...]) -> Column:
    """The longest known city with which a text ends after a space or comma, as it is written there; null for none."""
    plain = F.translate(F.lower(value), "áéíóúüñ", "aeiouun")
    held = F.filter(F.array(*[F.lit(c) for c in cities]), lambda c: F.endswith(plain, F.concat(F.lit(" "), c)) | F.endswith(plain, F.concat(F.lit(","), c)))
    size = F.array_max(F.transform(held, lambda c: F.length(c)))
    return F.when(size.isNotNull(), F.right(value, size))


def address(text: Column, cities: tuple[str, ...] = CITIES) -> Column:
    """(street_1, street_2, city) of a notice: the place that it names, its crossing, and the city at its end, told by the names known.

    The city may stand after a comma or right after a street. What stands after a comma and is no known city stays with
    the street. A text that names no place gives nulls.
    """
    clean = lambda c: F.nullif(F.btrim(c, F.lit(" ,.")), F.lit(""))

    def told(parts: Column) -> Column:
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        in_second = _city_at_end(second, cities)
        city = F.coalesce(in_second, _city_at_end(first, cities))
        shorter = lambda c: F.left(c, F.length(c) - F.length(city))
        one = F.when(in_second.isNull() & city.isNotNull(), shorter(first)).otherwise(first)
        two = F.when(in_second.isNotNull(), shorter(second)).otherwise(second)
        return F.struct(clean(one).alias("street_1"), clean(two).alias("street_2"), clean(city).alias("city"))

    return once(street_parts(text), told)
