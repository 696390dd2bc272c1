"""Quality rules as a short-circuit cascade, ordered by rejection per cost as measured on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.words import SPACE, U, Texts, Words, chunks, grams, scramble, span_hashes

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LATIN = _UPPER.copy()
_LATIN[97:123] = True


class Batch:
    """Texts with their measures, each computed when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column
        self._known: dict[str, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.column)

    def part(self, keep: np.ndarray) -> Batch:
        """The kept rows; measures that are known stay known."""
        out = Batch(self.column.filter(pa.array(keep)))
        out._known = {k: v[keep] for k, v in self._known.items() if not k.startswith("_")}
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    @property
    def texts(self) -> Texts:
        if "_texts" not in self._known:
            self._known["_texts"] = Texts(self.column)
        return self._known["_texts"]

    @property
    def words(self) -> Words:
        if "_words" not in self._known:
            self._known["_words"] = Words(self.texts)
        return self._known["_words"]

    def _count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text have a value that the table marks."""
        mask = table[self.texts.buf]
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[self.texts.ends] - total[self.texts.starts]

    def _n_words(self) -> np.ndarray:
        return self.words.counts().astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        continued = np.zeros(256, bool)
        continued[0x80:0xC0] = True
        return self._count(~(SPACE | continued))

    def _n_symbols(self) -> np.ndarray:
        return self._count(_SYMBOL)

    def _n_upper(self) -> np.ndarray:
        return self._count(_UPPER)

    def _n_latin(self) -> np.ndarray:
        return self._count(_LATIN)

    def _n_letters(self) -> np.ndarray:
        """Letters of any script."""
        return pc.fill_null(pc.count_substring_regex(self.column, r"\pL"), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Owner, start and end of each line that has a word."""
        t = self.texts
        breaks = np.flatnonzero(t.buf == 10)
        owner = np.searchsorted(t.starts, breaks, side="right") - 1
        starts = np.concatenate([t.starts, breaks + 1])
        ends = np.concatenate([t.ends, breaks])
        own = np.concatenate([np.arange(len(t)), owner])
        order = np.lexsort((starts, own))
        starts, own = starts[order], own[order]
        order = np.lexsort((ends, np.concatenate([np.arange(len(t)), owner])))
        ends = ends[order]
        full = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.starts, starts)
        return own[full], starts[full], ends[full]

    def _line_stats(self) -> tuple[np.ndarray, np.ndarray]:
        own, starts, ends = self._lines()
        lines = np.bincount(own, minlength=len(self))
        # Each distinct line counts once: the others of its text are repeats.
        key = span_hashes(self.texts.buf, starts, ends) ^ scramble(own.astype(U) + U(1))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[1:] = key[order][1:] == key[order][:-1]
        dup = np.bincount(own[order][again], minlength=len(self))
        return lines.astype(np.int64), dup.astype(np.int64)

    def _n_lines(self) -> np.ndarray:
        lines, self._known["n_dup_lines"] = self._line_stats()
        return lines

    def _n_dup_lines(self) -> np.ndarray:
        self._known["n_lines"], dup = self._line_stats()
        return dup

    def _n_repeat_words(self) -> np.ndarray:
        w = self.words
        own = w.owner()
        g = grams(w.hashes(), 3)
        inside = np.flatnonzero(own[: len(g)] == own[2:]) if len(g) else np.zeros(0, np.int64)
        key = g[inside] ^ scramble(own[inside].astype(U) + U(1))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        covered = np.zeros(len(own), bool)
        for k in range(3):
            covered[at + k] = True
        return np.bincount(own[covered], minlength=len(self)).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """rejects: from a batch, a truth value a row."""

    name: str
    rejects: Callable[[Batch], np.ndarray]


#: Thresholds of the rules in use, stated as fixed values.
FEW_WORDS = Rule("few_words", lambda b: b["n_words"] < 50)
REPEATS = Rule("repeats", lambda b: 100 * b["n_repeat_words"] > 50 * b["n_words"])
SYMBOL_SHARE = Rule("symbols", lambda b: 10 * b["n_symbols"] > b["n_words"])
WORD_LENGTH = Rule("word_length", lambda b: (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"]))
LINE_REPEATS = Rule("line_repeats", lambda b: 100 * b["n_dup_lines"] > 30 * b["n_lines"])  # the published share of Gopher's rules


def _capitals(b: Batch) -> np.ndarray:
    """More than half of the letters, of whatever script, are A-Z: a few acronyms in a Russian text weigh nothing."""
    out = 2 * b["n_upper"] > b["n_latin"]
    if out.any():  # all letters are counted only where these of A-Z alone would reject
        some = b.part(out)
        out[out] = 2 * some["n_upper"] > some["n_letters"]
    return out


CAPITALS = Rule("capitals", _capitals)
BASE = (FEW_WORDS, REPEATS)
RULES = (*BASE, SYMBOL_SHARE, WORD_LENGTH, LINE_REPEATS, CAPITALS)


def cascade(batch: Batch, rules: list[Rule]) -> np.ndarray:
    """The place in `rules` of the first that rejects each row, -1 for kept rows; each rule sees what those before it kept."""
    first = np.full(len(batch), -1)
    at, left = np.arange(len(batch)), batch
    for k, rule in enumerate(rules):
        if not len(left):
            break
        out = rule.rejects(left)
        first[at[out]] = k
        if out.any():
            at, left = at[~out], left.part(~out)
    return first


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample: int = 2000) -> list[Rule]:
    """The rules by rejections per second, the best first, as measured on about `sample` documents.

    Each rule is timed by itself on fresh batches, so a measure that two rules share counts for both. The order
    changes the work only: a document is kept if no rule rejects it, whatever the order.
    """
    n = docs.count()
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            seconds, rejected = [], []
            for r in rules:
                began = time.perf_counter()
                rejected.append(int(r.rejects(Batch(batch.column("text"))).sum()))
                seconds.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_pydict({"name": names, "seconds": seconds, "rejected": rejected})

    some = docs.select("text").sample(min(1.0, sample / max(n, 1)), seed=11)
    found = some.mapInArrow(measure, "name string, seconds double, rejected long").groupBy("name").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("n")).collect()
    gain = {r["name"]: r["n"] / max(r["s"], 1e-9) for r in found}
    return sorted(rules, key=lambda r: -gain.get(r.name, 0.0))


def judge(docs: DataFrame, rules: list[Rule], measures: tuple[str, ...] = (), base: tuple[Rule, ...] = ()) -> DataFrame:
    """(doc_id, the measures, base_failed, rejected_by, kept) of (doc_id, text) rows.

    rejected_by names the first rule of the cascade that rejects a row, null if kept. The base rules, if given, go
    first and are told apart by base_failed. A null text has no words and is judged like an empty one. Rows are
    judged by themselves: nulls in doc_id, repeated rows and ties need no care.
    """
    kinds = "".join(f", {m} long" for m in measures)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [r.name for r in (*base, *rules)]
        for rows in chunks(batches):
            batch = Batch(rows.column("text"))
            columns = {"doc_id": rows.column("doc_id"), **{m: pa.array(batch[m], pa.int64()) for m in measures}}
            first = cascade(batch, [*base, *rules])
            columns["base_failed"] = pa.array((first >= 0) & (first < len(base)))
            columns["rejected_by"] = pa.array([names[k] if k >= 0 else None for k in first], pa.string())
            columns["kept"] = pa.array(first < 0)
            yield pa.RecordBatch.from_pydict(columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{kinds}, base_failed boolean, rejected_by string, kept boolean")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 2000) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are; the cascade's order comes from a sample."""
    plan = estimate(docs, rules, sample)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches):
            yield rows.filter(pa.array(cascade(Batch(rows.column("text")), plan) < 0))

    return docs.mapInArrow(run, schema)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every document's measures and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plan = estimate(docs, tuple(r for r in RULES if r not in BASE))
    return judge(docs, plan, MEASURES, BASE).select("doc_id", *MEASURES, "base_failed", "kept")


#: The kept documents' condition and the measures, over a relation `docs` of doc_id and text.
MEASURE_SQL = r"""
words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM docs
), triples AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)
), covered AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM triples) WHERE c >= 2
), repeated AS (
  SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
), lined AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words
), measured AS (
  SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\pL]', '', 'g')) AS n_letters
  FROM lined l LEFT JOIN repeated r ON l.doc_id = r.doc_id
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_upper > n_letters AS rejected
  FROM measured
)"""

ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, text FROM documents), {MEASURE_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM judged
"""
