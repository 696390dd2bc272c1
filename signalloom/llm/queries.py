"""The corpus queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import automata, bpe, jaccard, language, mixing, packing, quality, resampling, search, sharding, suffixes, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_shards": sharding.query,
        "op2_systematic_mix": mixing.query,
        "op3_suffix_automata_dedup": automata.query,
        "op4_rank_order_language": language.query,
        "op5_quality_cascade": quality.query,
        "op6_best_fit_pack": packing.query,
        "op7_ngram_jaccard_join": jaccard.query,
        "op8_url_trees": urls.query,
        "op9_suffix_array_dedup": suffixes.query,
        "op10_kd_tree_search": search.query,
        "op11_subspace_whitening": whitening.query,
        "op12_byte_bpe": bpe.query,
        "op13_importance_resampling": resampling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_systematic_mix": mixing.ORACLE_SQL,
        "op3_suffix_automata_dedup": automata.ORACLE_SQL,
        "op5_quality_cascade": quality.ORACLE_SQL,
        "op7_ngram_jaccard_join": jaccard.ORACLE_SQL,
        "op10_kd_tree_search": search.ORACLE_SQL,
    }
