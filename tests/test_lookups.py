from pyspark.sql import functions as F

from signalloom.functions import text
from signalloom.sources import lookups


def stamp(day):
    return F.lit(f"2024-{day}").cast("timestamp")


def test_a_second_run_asks_nothing(spark):
    said = ["Accidente en Av. España con Uno Norte, Viña del Mar."] * 3 + ["Choque en Ruta 68."] * 2 + ["Choque en Calle Perdida, Limache.", "Sin lugar"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "id int, said string").withColumn("a", text.address(F.col("said")))
    rows = rows.withColumn("query", lookups.query_text(F.col("a.street_1"), F.col("a.street_2"), F.col("a.city"))).drop("a")
    place = {"Av. España y Uno Norte, Viña del Mar, Región de Valparaíso": (-33.02, -71.55), "Ruta 68, Región de Valparaíso": (-33.1, -71.4)}
    known, asked = lookups.no_answers(spark), []

    def run(day, most=2):
        nonlocal known
        got, queue = lookups.placed(rows, known, stamp(day), most)
        got, wanted = {r["id"]: (r["lat"], r["lon"]) for r in got.collect()}, [tuple(r) for r in queue.collect()]
        asked.append([q for q, _ in wanted])
        found = spark.createDataFrame([(q, *place[q]) for q, _ in wanted if q in place], "query string, lat double, lon double")
        queue = spark.createDataFrame(wanted, "query string, uses long")
        known = spark.createDataFrame(lookups.answered(known, queue, found, stamp(day)).collect(), lookups.ANSWERS)
        return got

    assert set(run("01-01").values()) == {(None, None)}
    assert asked[-1] == list(place)  # the two of most use
    got = run("01-02")
    assert asked[-1] == ["Calle Perdida, Limache, Región de Valparaíso"]
    assert got[0] == got[2] == (-33.02, -71.55) and got[3] == (-33.1, -71.4) and got[5] == got[6] == (None, None)
    assert run("01-03") == got and asked[-1] == []
    assert run("01-12") == got and asked[-1] == ["Calle Perdida, Limache, Región de Valparaíso"]  # the one not found is tried again
    run("07-15", 9)
    assert asked[-1] == [*place, "Calle Perdida, Limache, Región de Valparaíso"] and known.count() == 3


def test_queries_and_empty_tables(spark):
    row = spark.range(1).select(
        lookups.query_text(F.lit(None), F.lit("B"), F.lit("Limache")).alias("none"), lookups.query_text(F.lit("A"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("one")
    ).first()
    assert tuple(row) == (None, "A, Región de Valparaíso")
    none = spark.createDataFrame([], "id int, query string")
    got, queue = lookups.placed(none, lookups.no_answers(spark), stamp("01-01"))
    assert got.collect() == queue.collect() == []
