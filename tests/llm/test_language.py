import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from signalloom.llm import language
from signalloom.llm.language import gram_codes, identify, profiles, ranked_codes


def test_held_out_accuracy(spark):
    got = language.query(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert got.count() == 1000 and len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_grams_match_slicing():
    text = "Abc de-f, ÉG"
    words = ["abc", "de", "f", "ég"]
    padded = "".join(f"_{w}" for w in words) + "_"
    want = sorted(padded[i : i + n] for n in range(1, 6) for i in range(len(padded) - n + 1) if "_" not in padded[i + 1 : i + n - 1] and padded[i : i + n].strip("_"))
    assert len(gram_codes(text)) == len(want)
    assert len(set(gram_codes(text))) == len(set(want))
    assert len(gram_codes("12 !? ")) == 0 == len(gram_codes(""))
    assert list(ranked_codes(gram_codes("aaa aaa")))[0] in gram_codes("a")


def brute_grams(text):
    """Strings in place of codes: letters and marks of words, a neighbouring gap as _."""
    kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    if not any(c.isalpha() for c in kept):
        return Counter()
    padded = "_" + "".join(f"{w}_" for w in kept.split())
    return Counter(g for n in range(1, 6) for i in range(len(padded) - n + 1) for g in [padded[i : i + n]] if "_" not in g[1:-1] and g.strip("_"))


def brute_ranks(counts, codes):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], codes[x[0]]))[:300]]


def test_distances_match_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(-1, "ящик щука ёж подъезд " * 9, "ru"), (-2, "सत्य की जीत होती है सत्य " * 9, "hi"), (-3, "漢字 かな " * 9, "ja"), (-4, "щука и ёж", None), (-5, "की जीत", None)], "doc_id long, text string, lang string")
    docs = docs.union(extra)
    known = profiles(docs.where("lang is not null"), 10**9)
    rows = docs.collect()
    # A code for each gram, by walking text and codes alike: both list the grams of one length in order of place.
    codes = {}
    for r in rows:
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (r["text"] or "").lower())
        padded = "_" + "".join(f"{w}_" for w in kept.split())
        listed = [g for n in range(1, 6) for i in range(len(padded) - n + 1) for g in [padded[i : i + n]] if "_" not in g[1:-1] and g.strip("_")]
        assert len(listed) == len(gram_codes(r["text"] or ""))
        codes.update(zip(listed, gram_codes(r["text"] or "").tolist()))
    assert len(set(codes.values())) == len(codes)
    by_lang = {}
    for r in rows:
        if r["lang"] is not None:
            by_lang.setdefault(r["lang"], Counter()).update(brute_grams(r["text"] or ""))
    want = {lang: brute_ranks(counts, codes) for lang, counts in by_lang.items()}
    assert {lang: [codes[g] for g in grams] for lang, grams in want.items()} == {lang: x.tolist() for lang, x in known.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs, known, ["doc_id"]).collect()}
    for r in rows:
        own = brute_ranks(brute_grams(r["text"] or ""), codes)
        if not own:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        far = {lang: sum(abs(place[g] - i) if g in place else 300 for i, g in enumerate(own)) for lang, ranks in want.items() for place in [{g: i for i, g in enumerate(ranks)}]}
        best = min(sorted(far), key=far.get)
        assert got[r["doc_id"]] == (best, 1 - far[best] / (300 * len(own)))
    assert got[-4][0] == "ru" and got[-5][0] == "hi"


def test_odd_rows(spark):
    rows = [(1, "the cat sat on the mat and the dog", "en", "c"), (2, "le chat est sur la table et le chien", "fr", "c"), (3, "words", None, "c"), (None, None, "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    known = profiles(docs)
    assert sorted(known) == ["en", "fr"]
    odd = spark.createDataFrame([(1, "the dog", "x"), (1, "the dog", "x"), (None, None, None), (4, "123 \n", ""), (5, "", ""), (6, "ж" * 100_000, ""), (7, "chien sur la table", "")], "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"]) for r in identify(odd, known, ["doc_id"]).collect()]
    assert got[:5] == [(1, "en"), (1, "en"), (None, "und"), (4, "und"), (5, "und")] and got[6] == (7, "fr") and got[5][1] in known
    assert identify(odd.limit(0), known, ["doc_id"]).collect() == []
    assert profiles(docs.limit(0)) == {}
    assert [r["lang_pred"] for r in identify(odd, {}, ["doc_id"]).collect()] == ["und"] * 7


def test_ids_are_split_by_their_text(spark):
    import zlib

    rows = spark.range(50).withColumn("h", language.held_out(F.col("id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
