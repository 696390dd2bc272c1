import pytest
from pyspark.sql import functions as F

from signalloom.functions import text


def values(spark, column, said):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", column(F.col("s")).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


CODES = {
    "10-4": [[10, 4]],
    "10-0-4": [[10, 4]],
    "10-4-1": [[10, 4, 1]],
    "10-40": [[10, 40]],
    "10-4-2026": [],
    "10 – 4": [[10, 4]],
    "10—4": [[10, 4]],
    "10.4 / B1": [[10, 4]],
    "10/4": [[10, 4]],
    "Despacho 10-4 y luego 10-0-1 en el mismo sector": [[10, 4], [10, 1]],
    "10--4": [],
    "calle 1234": [],
    "110-4": [],
    "-10-4-": [[10, 4]],
    "": [],
    None: None,
}


def test_radio_codes(spark):
    assert values(spark, text.radio_codes, CODES) == list(CODES.values())


STREETS = {
    "Accidente en Av. España con Uno Norte, Viña del Mar. Tránsito lento": ["Av. España", "Uno Norte, Viña del Mar"],
    "Colisión en Ruta 68.": ["Ruta 68"],
    "Choque sobre Gral. Velásquez esquina de Pdte. Ibáñez; equipos en camino": ["Gral. Velásquez", "Pdte. Ibáñez"],
    "Atropello FRENTE A Hospital Gustavo Fricke precaución al conducir": ["Hospital Gustavo Fricke"],
    "Volcamiento a la altura de km. 12 esquina Los Pinos se recomienda otra ruta": ["km. 12", "Los Pinos"],
    "Choque en Colón y Errázuriz personal en el lugar": ["Colón", "Errázuriz"],
    "Choque en Colón / Errázuriz, Carabineros en el lugar": ["Colón", "Errázuriz"],
    "Sin novedad": [],
    "en": [],
    "": [],
    None: None,
}


def test_street_parts(spark):
    assert values(spark, text.street_parts, STREETS) == list(STREETS.values())


ADDRESSES = {
    "Accidente vehicular en Av. España con Uno Norte, Viña del Mar. Tránsito lento hacia el poniente.": ("Av. España", "Uno Norte", "Viña del Mar"),
    "Colisión en Avenida Argentina esquina Pedro Montt, Valparaíso.": ("Avenida Argentina", "Pedro Montt", "Valparaíso"),
    "Choque múltiple en Ruta 68. Se recomienda precaución.": ("Ruta 68", None, None),
    "Accidente en Av. España, Valparaíso.": ("Av. España", None, "Valparaíso"),
    "Colisión en Gral. Velásquez, Quilpué.": ("Gral. Velásquez", None, "Quilpué"),
    "Volcamiento en Pje. Los Aromos, Limache.": ("Pje. Los Aromos", None, "Limache"),
    "Accidente en Ruta 68. Tránsito lento hacia Casablanca.": ("Ruta 68", None, None),
    "Choque en Av. España con Uno Norte Viña del Mar": ("Av. España", "Uno Norte", "Viña del Mar"),
    "Choque en Av. España, sentido poniente": ("Av. España, sentido poniente", None, None),
    "Choque en Camino San Antonio con Los Andes": ("Camino", "Los Andes", "San Antonio"),
    "Choque en Calle Nuevaconcon": ("Calle Nuevaconcon", None, None),
    "Accidente en Valparaíso": ("Valparaíso", None, None),
    "Accidente vehicular con dos lesionados.": (None, None, None),
    "   ": (None, None, None),
}


def test_addresses(spark):
    got = values(spark, text.address, ADDRESSES)
    assert [tuple(r) for r in got] == list(ADDRESSES.values())


@pytest.mark.parametrize("prefix,wanted", [((10, 4), [True, False]), ((10,), [True, True])])
def test_has_code(spark, prefix, wanted):
    assert values(spark, lambda s: text.has_code(text.radio_codes(s), prefix), ["10-4-1", "10-40"]) == wanted


def test_texts_without_tags_are_stripped_too(spark):
    said = ["", " ", "a", " a", "a ", "a  b", "a\tb", "a\n", " a b", "a > b", "a<b", "<p>a</p>b", "a<br> b", "é", "x & y", "&amp;lt;", "<style>a</STYLE> b", "<script>a", "\x1ca", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(said)], "k int, x string")
    want = ["", "", "a", "a", "a", "a b", "a b", "a", "a b", "a > b", "a<b", "a b", "a b", "é", "x & y", "&lt;", "b", "a", "\x1ca", None]
    assert [r[0] for r in df.orderBy("k").select(text.strip_html(F.col("x"))).collect()] == want
