"""Target-distribution importance resampling over hashed n-grams, by postings partitioned by bucket.

Each text's buckets are written once as postings lists, cut into shelves of neighbouring buckets. A shelf's lists meet
the counts that both corpora have of its buckets, block by block of documents; there the gains are worked out and each
list becomes one contribution to its document. Contributions are added up by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalloom.llm.words import chunks
from signalloom.tables import materialise, numbered

#: Shelves of buckets, and postings of a block that one task holds at a time, about.
SHELVES, BLOCK = 16, 250_000
#: Hashes of n-grams that a worker remembers.
_KNOWN = 500_000
# Bytes of words are digits, letters and all bytes over 127; A-Z are lower-cased, all others part words.
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


class Buckets(dict):
    """The bucket of each n-gram: its bytes' unsigned crc32 modulo their number."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, gram: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        found = zlib.crc32(gram) % self.buckets
        if len(gram) <= 64:
            self[gram] = found
        return found


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def features(found: list[bytes], longest: int) -> Iterator[bytes]:
    """All runs of 1 to `longest` consecutive words, joined by one space."""
    yield from found
    for n in range(2, longest + 1):
        for i in range(len(found) - n + 1):
            yield b" ".join(found[i : i + n])


LISTS = "uid long, doc_id {kind}, n_words long, n_features long, shelf int, buckets array<int>, counts array<int>"


def postings(docs: DataFrame, buckets: int, longest: int = 1) -> DataFrame:
    """Postings lists of (doc_id, text), written as a table: for each row one with shelf -1 and its counts of words and features, and one a shelf that it has buckets of.

    uid tells rows apart, equal ones too. It is given while the lists are written, and read from there ever after.
    """
    width = -(-buckets // SHELVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Buckets(buckets)
        for rows in chunks(batches):
            texts = rows.column("text").cast(pa.binary()).to_pylist()
            n_words, n_features, where = [], [], []
            for text in texts:
                found = words(text) if text else []
                n_words.append(len(found))
                grams = found if longest == 1 else features(found, longest)
                where.append(np.fromiter(map(bucket_of.__getitem__, grams), np.int64))
                n_features.append(len(where[-1]))
            owner = np.repeat(np.arange(len(texts)), n_features)
            # By row, then bucket: the counts of each, in order.
            keys, counts = np.unique(owner * buckets + (np.concatenate(where) if where else 0), return_counts=True)
            row, bucket = np.divmod(keys, buckets)
            group = row * SHELVES + bucket // width
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            offsets = pa.array(np.concatenate([np.zeros(len(texts), np.int64), starts, [len(keys)]]).astype(np.int32))
            lists = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
            whose = np.concatenate([np.arange(len(texts)), row[starts]])
            none = pa.nulls(len(starts), pa.int64())
            taken = pa.array(whose)
            yield pa.RecordBatch.from_pydict({
                "uid": rows.column("uid").take(taken),
                "doc_id": rows.column("doc_id").take(taken),
                "n_words": pa.concat_arrays([pa.array(n_words, pa.int64()), none]),
                "n_features": pa.concat_arrays([pa.array(n_features, pa.int64()), none]),
                "shelf": pa.array(np.concatenate([np.full(len(texts), -1), (bucket // width)[starts]]).astype(np.int32)),
                "buckets": lists(bucket), "counts": lists(counts),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    return materialise(rows.mapInArrow(run, LISTS.format(kind=kind)), "postings")


def bucket_counts(lists: DataFrame, name: str) -> DataFrame:
    """(bucket, `name`, lists): features of all texts in each bucket, and in how many lists it is; partial sums go before the shuffle."""
    each = lists.where("shelf >= 0").select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return each.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum(F.col("p.counts").cast("long")).alias(name), F.count(F.lit(1)).alias(f"{name}_lists"))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """What one feature of a bucket adds to a weight: the logarithm of how much likelier the target makes it, in thousandths."""
    return math.floor(1000 * math.log((float(t + 1) * float(all_s + buckets)) / (float(s + 1) * float(all_t + buckets))))


def weights(lists: DataFrame, target: DataFrame, buckets: int, block: int = BLOCK) -> DataFrame:
    """(uid, doc_id, n_words, n_features, weight) of the documents of `lists`, by the gain of `target` (postings lists too) over them.

    Blocks of documents part the lists of a shelf by a hash of uid, in as many as keep about `block` postings in each:
    a bucket that every document has is in every block, and no task gathers it. With a block goes its shelf's counts,
    which are at most buckets / SHELVES rows.
    """
    width = -(-buckets // SHELVES)
    s, t = bucket_counts(lists, "s"), bucket_counts(target, "t").drop("t_lists")
    both = s.join(t, "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t", "s_lists")])
    both = materialise(both, "gains")  # `buckets` rows at most
    all_s, all_t, total = both.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("s", "t", "s_lists")]).first()
    blocks = max(1, -(-total // (SHELVES * block)))
    mine = lists.where("shelf >= 0").select("shelf", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "uid", "buckets", "counts")
    counts = both.where("s > 0").withColumn("shelf", F.floor(F.col("bucket") / width).cast("int"))
    counts = counts.groupBy("shelf").agg(F.collect_list(F.struct("bucket", "s", "t")).alias("c"))  # at most `width` of each
    counts = counts.select("shelf", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1).cast("long"))).alias("block"), F.col("c.bucket").alias("bucket"), F.col("c.s").alias("s"), F.col("c.t").alias("t"))

    def meet(here: pa.Table, known: pa.Table) -> pa.Table:
        if not here.num_rows:
            return pa.table({"uid": pa.array([], pa.int64()), "part": pa.array([], pa.int64())})
        row = {c: known.column(c)[0].as_py() for c in ("shelf", "bucket", "s", "t")}
        gains = np.zeros(width, np.int64)
        gains[np.array(row["bucket"]) - row["shelf"] * width] = [gain(a, b, all_s, all_t, buckets) for a, b in zip(row["s"], row["t"])]
        lists_, times = (here.column(c).combine_chunks() for c in ("buckets", "counts"))
        worth = gains[lists_.flatten().to_numpy() - row["shelf"] * width] * times.flatten().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists_).to_numpy())])
        total = np.concatenate([[0], np.cumsum(worth)])
        return pa.table({"uid": here.column("uid"), "part": pa.array(total[ends[1:]] - total[ends[:-1]])})

    parts = mine.groupBy("shelf", "block").cogroup(counts.groupBy("shelf", "block")).applyInArrow(meet, "uid long, part long")
    own = lists.where("shelf = -1").select("uid", "doc_id", "n_words", "n_features", F.lit(0).cast("long").alias("part"))
    kind = own.schema["doc_id"].dataType
    rest = parts.select("uid", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("long").alias("n_features"), "part")
    return own.unionByName(rest).groupBy("uid").agg(*[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")], F.sum("part").alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of `seed:doc_id`; a null id counts as the word null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10000, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text): those drawn towards `target` (text) have a rank.

    Of the rows with `least_words` words and more, `percent` in a hundred are drawn without replacement, by score, then
    the smaller doc_id (null last). Null and empty texts have no features and weight 0. Equal rows are rows of their own
    with equal scores, and a doc_id may come twice: rows are told apart by numbers of their own. An empty target gives
    each bucket the gain of a count of 0; an empty table no rows. Columns besides doc_id and text are not looked at.
    """
    lists = postings(docs, buckets, longest)
    wanted = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    found = weights(lists, wanted, buckets).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    many = lists.where((F.col("shelf") == -1) & (F.col("n_words") >= least_words)).count() * percent // 100
    found = found.withColumns({"_out": F.col("n_words") < least_words, "_down": -F.col("score")})
    order = ["_out", "_down", F.col("doc_id").asc_nulls_last(), "uid"]
    ranked = numbered(found, order, "_rank")
    drawn = F.when(~F.col("_out") & (F.col("_rank") <= many), F.col("_rank").cast("long"))
    return ranked.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: a tenth of the documents drawn towards the benchmark's texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
