"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from wayfold.llm import decontamination, hash_tree, language_model, licenses, mixing, pipeline, quality, quality_rules, simhash, substrings, warc


def queries() -> dict:
    return {
        "op1_substrings": substrings.op1,
        "op2_simhash": simhash.op2,
        "op3_license_scan": licenses.op3,
        "op4_source_mix": mixing.op4,
        "op5_warc": warc.op5,
        "op6_leaks": decontamination.op6,
        "op7_quality": quality.op7,
        "op8_shards": hash_tree.op8,
        "op9_language_model": language_model.op9,
        "op10_quality_rules": quality_rules.op10,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.OP3_SQL, "op4_source_mix": mixing.OP4_SQL}
