"""The corpus operators' queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, flac, licenses, line_dedup, lm_score, mixing, ngram_join, pii, quality, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.query,
    "op2_lm_score": lm_score.query,
    "op3_decontamination": decontam.query,
    "op4_pii": pii.query,
    "op5_quality": quality.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_flac": flac.query,
    "op8_mixing": mixing.query,
    "op9_licenses": licenses.query,
    "op10_ngram_join": ngram_join.query,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_decontamination": decontam.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op7_flac": flac.SQL,
    "op10_ngram_join": ngram_join.SQL,
}
