"""Language identification by rank-order n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalloom.llm.words import U, chunks, grams, scramble

#: Longest n-gram, and n-grams in a profile.
LONGEST, PROFILE = 5, 300
_TABLE: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for the marks that letters carry, 0 for all else."""
    if "kinds" not in _TABLE:
        kind = {"L": 2, "M": 1}
        _TABLE["kinds"] = np.array([kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.int8)
    return _TABLE["kinds"]


def _symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased letters and their marks, each run of other characters (and both ends) as one 0; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kind = _kinds()[points]
    if not (kind == 2).any():
        return np.zeros(0, np.int64)
    out = np.zeros(len(points) + 2, np.int64)
    out[1:-1] = np.where(kind > 0, points, 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of 1 to LONGEST symbols inside words, one neighbouring gap included; empty without letters.

    A code is a 64-bit hash of the symbols' whole code points.
    """
    s = _symbols(text)
    if not len(s):
        return np.zeros(0, np.int64)
    gap = s == 0
    symbols = s.astype(U)
    code = grams(symbols, 1)
    found, inner = [code[~gap]], np.zeros(len(s), bool)
    for n in range(2, LONGEST + 1):
        m = len(s) - n + 1
        if m <= 0:
            break
        code = scramble(code[:m] * U(n | 1) + symbols[n - 1 :])
        inner = inner[:m] | gap[n - 2 : n - 2 + m] if n > 2 else np.zeros(m, bool)
        found.append(code[~inner])
    return np.concatenate(found).view(np.int64)


def ranked_codes(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


#: Up to so many langs are broadcast with their counts.
FEW_LANGS = 10_000


def profiles(labelled: DataFrame, per_lang: int = 1000) -> dict[str, np.ndarray]:
    """Each lang's PROFILE most frequent n-grams, counted over whole texts of about `per_lang` documents of (doc_id, text, lang).

    The documents of a lang are chosen by a hash of doc_id and text, at the rate that gives `per_lang`. What reaches
    the driver has PROFILE rows a lang. Null texts and null langs are left out.
    """
    labelled = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).persist()
    counts = F.broadcast(counts) if counts.count() <= FEW_LANGS else counts
    sample = labelled.join(counts, "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) * F.col("_n") < F.lit(per_lang << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                by.setdefault(lang, []).append(gram_codes(text))
            for lang, codes in by.items():
                values, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(values), pa.string()), "code": values, "n": n.astype(np.int64)})

    total = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "code")
    top = total.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= PROFILE).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("_r", "code")))["code"].alias("codes")).collect()
    return {r["lang"]: np.array(r["codes"], np.int64) for r in top}


def identify(docs: DataFrame, known: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """The key columns with lang_pred and score, from the text alone.

    The out-of-place distance sums, over a document's most frequent n-grams, how far each stands from its rank in
    a language's profile, PROFILE if it is missing there. The nearest language wins, ties by its name; score is one
    less the distance's share of the largest possible. A null text, and one without a letter, is `und` with score
    0, as is any text when no language is known.
    """
    langs = sorted(known)
    lookup = []
    for lang in langs:
        order = np.argsort(known[lang])
        lookup.append((known[lang][order], order))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def distance(codes: np.ndarray, profile: np.ndarray, rank: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(profile, codes), len(profile) - 1)
        places = np.abs(rank[at] - np.arange(len(codes)))
        return int(np.where(profile[at] == codes, places, PROFILE).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            names, scores = [], []
            for text in rows.column("text").to_pylist():
                codes = ranked_codes(gram_codes(text)) if text and langs else ()
                if not len(codes):
                    names.append("und")
                    scores.append(0.0)
                    continue
                found = [distance(codes, *x) for x in lookup]
                k = int(np.argmin(found))
                names.append(langs[k])
                scores.append(1.0 - found[k] / (PROFILE * len(codes)))
            yield pa.RecordBatch.from_pydict({**{k: rows.column(k) for k in keys}, "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select(*keys, "text").mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the language of every document, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    known = profiles(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), known, ["doc_id", "held_out"])
