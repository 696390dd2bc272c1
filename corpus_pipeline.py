"""The corpus pipeline: documents filtered, deduplicated, mixed and packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalloom.llm.anchors import keyed
from signalloom.llm.automata import substring_dedup
from signalloom.llm.jaccard import first_rows
from signalloom.llm.mixing import mixed_documents
from signalloom.llm.packing import best_fit_pack, default_tokenizer
from signalloom.llm.quality import quality_filter
from signalloom.tables import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least doc_id, then of least hash of the text, then the other columns.

    Only texts make groups: unlike texts without a doc_id, or under one doc_id, all stay.
    """
    kept = first_rows(docs.select("doc_id", "text")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    rows = keyed(docs, docs.columns).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "rest.*")
    first = Window.partitionBy("_id", "_h").orderBy(*[c for c in docs.columns if c != "text"])
    found = rows.join(kept.hint("shuffle_hash"), ["_id", "_h"], "left_semi").withColumn("_r", F.row_number().over(first))
    return found.where("_r = 1").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words and more that a document of smaller doc_id has; n_chars follows.

    A document that loses no word keeps its text as it is; one that loses all its words goes.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring_dedup(docs, rest=rest).where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col(f"rest.`{c}`") for c in rest}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars")).cast("long")
    return out.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix of sources takes them; some come twice, some not at all."""
    return mixed_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces with their places in sequences of 2048 tokens."""
    return best_fit_pack(docs, default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", source_mix),
    ("best-fit packing", sequence_packing),
]

#: Token ids are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
