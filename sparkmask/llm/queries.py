"""The queries of this folder, by name, and the SQL that states their results where SQL can."""

from __future__ import annotations

import importlib

from .common import importable

#: Query: module and function.
OPERATORS = {
    "op1_license_scan": ("licenses", "op1"),
    "op2_minhash_dedup": ("near_duplicates", "op2"),
    "op3_quality_rules": ("quality", "op3"),
    "op4_pack_sequences": ("packing", "op4"),
    "op7_toxicity": ("toxicity", "op7"),
    "op8_extract_html": ("pages", "op8"),
    "op9_class_lm": ("language_model", "op9"),
    "op10_sentencepiece": ("subwords", "op10"),
    "op5_winnowing": ("fingerprints", "op5"),
    "op6_ring_shards": ("sharding", "op6"),
}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(importable(spark), sf_dir)


def queries() -> dict:
    def of(module: str, function: str):
        return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), function)(importable(spark), sf_dir)

    return {name: of(*where) for name, where in OPERATORS.items()} | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return {}
