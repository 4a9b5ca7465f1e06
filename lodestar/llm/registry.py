"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bin_packing, fill_in_middle, fingerprints, html_extraction, jaccard_join, line_dedup, lm_scoring, mix_sources, secret_scans, spelling_variants, suffix_dedup, topk_search, toxicity


def _over(name: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(_table(spark, sf_dir, name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {
        "op1_topk_search": _over("embeddings", topk_search.op1_topk_search),
        "op2_secret_scans": _over("documents", secret_scans.op2_secret_scans),
        "op3_line_dedup": _over("documents", line_dedup.op3_line_dedup),
        "op4_html_extraction": _over("pages", html_extraction.op4_html_extraction),
        "op5_suffix_dedup": _over("documents", suffix_dedup.op5_suffix_dedup),
        "op6_fingerprints": _over("documents", fingerprints.op6_fingerprints),
        "op7_bin_packing": _over("documents", bin_packing.op7_bin_packing),
        "op8_mix_sources": _over("documents", mix_sources.op8_mix_sources),
        "op9_toxicity": lambda spark, sf_dir: toxicity.op9_toxicity(
            _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
        ),
        "op10_jaccard_join": _over("documents", jaccard_join.op10_jaccard_join),
        "op11_lm_scoring": _over("documents", lm_scoring.op11_lm_scoring),
        "op12_fill_in_middle": _over("documents", fill_in_middle.op12_fill_in_middle),
        "op13_spelling_variants": _over("documents", spelling_variants.op13_spelling_variants),
    }


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {
        "op1_topk_search": topk_search.OP1_SQL,
        "op3_line_dedup": line_dedup.OP3_SQL,
        "op8_mix_sources": mix_sources.OP8_SQL,
        "op12_fill_in_middle": fill_in_middle.OP12_SQL,
        "op13_spelling_variants": spelling_variants.OP13_SQL,
    }
