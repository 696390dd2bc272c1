import re
import sys
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalloom.llm.packing import default_tokenizer

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_automata import brute as brute_passages  # noqa: E402
from test_jaccard import brute as brute_groups  # noqa: E402
from test_quality import brute as brute_measures  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_kept(text):
    n, chars, symbols, dup, repeat = brute_measures(text)
    lines = len([x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    upper, letters = len(re.findall("[A-Z]", text or "")), sum(c.isalpha() for c in text or "")
    return not (n < 50 or 2 * repeat > n or 10 * symbols > n or chars < 2 * n or chars > 15 * n or 100 * dup > 30 * lines or 2 * upper > letters)


def documents(spark, n=120):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 9000").orderBy("doc_id").limit(n)
    more = [(None, "w " * 60, "en", None, None), (5000, None, None, "src1", None), (5001, "", "en", "src1", 0)]
    return docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(more, SCHEMA))


def test_stages_match_brute_force(spark, tmp_path):
    docs = documents(spark)
    docs = docs.union(docs.where("doc_id in (3, 4, 5)").withColumn("doc_id", F.col("doc_id") + 9000))
    rows = {r["doc_id"]: r for r in docs.collect()}
    tables, sf = {}, "/root/testdata/sf0.001"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        tables[name] = docs.collect()
        if k < 4:
            assert docs.schema.simpleString() == documents(spark).schema.simpleString()
    kept = {i for i, r in rows.items() if brute_kept(r["text"])}
    assert {r["doc_id"] for r in tables["quality rules"]} == kept and 0 < len(kept) < len(rows)
    groups = brute_groups([(i, rows[i]["text"]) for i in kept])
    firsts = {d for d, _, c in groups if d == c}
    assert sorted(r["doc_id"] for r in tables["n-gram Jaccard join"]) == sorted(firsts) and len(firsts) < len(kept)
    passages = {d: (n, gone, text) for d, n, gone, _, text in brute_passages([(i, rows[i]["text"]) for i in firsts], 50)}
    left = {r["doc_id"]: r for r in tables["substring dedup"]}
    assert set(left) == {d for d, (n, gone, _) in passages.items() if gone == 0 or gone < n}
    assert all(r["text"] == passages[d][2] and r["n_chars"] == len(r["text"]) and r["source"] == rows[d]["source"] for d, r in left.items())
    mixed = tables["mixing sources"]
    taken = Counter(r["doc_id"] for r in mixed)
    assert set(taken) <= set(left) and max(taken.values()) <= 2
    assert all(r == left[r["doc_id"]] for r in mixed)
    words = sum(len(r["text"].split()) for r in left.values())
    assert abs(sum(len(r["text"].split()) for r in mixed) - 1.5 * words) <= 0.1 * words
    tok = Tokenizer.from_file(default_tokenizer())
    pieces = Counter()
    for r in tables["best-fit packing"]:
        pieces[r["doc_id"]] += r["length"]
    assert pieces == Counter({d: n * (len(tok.encode(left[d]["text"], add_special_tokens=False).ids) + 1) for d, n in taken.items()})


def test_unlike_texts_without_or_of_one_id_stay(spark):
    some = lambda g: [f"g{g}w{i}" for i in range(80)]
    near = lambda g, k: " ".join([*some(g)[:k], "other", *some(g)[k + 1 :]])
    rows = [(None, " ".join(some(g))) for g in range(4)] + [(7, " ".join(some(g))) for g in range(4, 7)]
    rows += [(1, near(0, 79)), (2, near(1, 79)), (7, near(4, 79)), (8, near(5, 79)), (None, " ".join(some(3))), (9, " ".join(some(9))), (9, " ".join(some(9)))]
    docs = spark.createDataFrame([(d, t, "en", f"s{k}", len(t)) for k, (d, t) in enumerate(rows)], SCHEMA)
    got = [corpus_pipeline.near_duplicates(spark, x, "").collect() for x in (docs, docs.repartition(3).orderBy(F.desc("source")))]
    assert sorted(got[0], key=str) == sorted(got[1], key=str)
    left = [(r["doc_id"], r["text"].split()[0][:2]) for r in got[0]]
    assert sorted(left, key=str) == sorted([(1, "g0"), (2, "g1"), (None, "g2"), (None, "g3"), (7, "g4"), (7, "g5"), (7, "g6"), (9, "g9")], key=str)
    assert {r["source"] for r in got[0] if r["doc_id"] == 9} == {"s12"} and {r["source"] for r in got[0] if r["text"].startswith("g3")} == {"s11"}


def test_clean_texts_of_other_scripts_stay(spark):
    words = {"ru": "программа работает быстро каждый день", "el": "το πρόγραμμα τρέχει γρήγορα σήμερα", "ar": "يعمل البرنامج بسرعة كل يوم", "hi": "यह प्रोग्राम हर दिन चलता है"}
    texts = [(k, " ".join(w + x[: i + 1] for i in range(4) for w in v.split() for x in v.split()) + " USB NATO") for k, v in words.items()]
    loud = " ".join(f"LOUD{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(80))
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, (k, t) in enumerate([*texts, ("en", loud)])], SCHEMA)
    assert sorted(r["lang"] for r in corpus_pipeline.quality_rules(spark, docs, "").collect()) == ["ar", "el", "hi", "ru"]


def test_repeated_rows_mix_each_for_itself(spark):
    from signalloom.llm.mixing import mixed_documents

    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)] * 4 + [(None, "x y", None, None, None)] * 2 + [(2, None, "en", "s", 0)], SCHEMA)
    got = Counter(tuple(r) for r in mixed_documents(docs).collect())
    assert 4 <= got[(1, "a b c", "en", "s", 5)] <= 8 and got[(None, "x y", None, None, None)] <= 4
    assert mixed_documents(docs.limit(0)).collect() == []


def test_empty_documents(spark, tmp_path):
    docs = documents(spark).limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0
