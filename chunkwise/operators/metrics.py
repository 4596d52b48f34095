"""Ratios, entropies, throughput and the gates that a run has to pass."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cdf import TOTAL


def ratio(compressed: Column, original: Column) -> Column:
    """Compressed by original bytes, summed over a group; 0 where there's no input."""
    return F.when(F.coalesce(F.sum(original), F.lit(0)) > 0, F.sum(compressed) / F.sum(original)).otherwise(F.lit(0.0))


def bits_per_byte(compressed: Column, original: Column) -> Column:
    return 8 * ratio(compressed, original)


def throughput_kb(size: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, size / 1024 / seconds)


def ideal_bits(counts: DataFrame, cdf: DataFrame, keys: list[str], on: list[str], n: str = "n") -> DataFrame:
    """(keys..., bits): the least bits in which counts of symbols can be written under a distribution."""
    return counts.join(cdf, on).groupBy(*keys).agg(F.sum(F.col(n) * -F.log2(F.col("width") / TOTAL)).alias("bits"))


def gates(runs: DataFrame, most_ratio: float = 0.11, least_kb: float = 200.0) -> DataFrame:
    """runs (name, comp, orig, encode_s, decode_s, exact) with a column for each gate, and whether all are passed."""
    r = F.when(F.col("orig") > 0, F.col("comp") / F.col("orig")).otherwise(0.0)
    checked = runs.withColumns({"ratio": r, "encode_kb_s": throughput_kb(F.col("orig"), F.col("encode_s")), "decode_kb_s": throughput_kb(F.col("orig"), F.col("decode_s"))})
    checked = checked.withColumns({"ratio_ok": F.col("ratio") <= most_ratio, "encode_ok": F.coalesce(F.col("encode_kb_s") >= least_kb, F.lit(False)), "decode_ok": F.coalesce(F.col("decode_kb_s") >= least_kb, F.lit(False))})
    return checked.withColumn("passed", F.col("ratio_ok") & F.col("encode_ok") & F.col("decode_ok") & F.col("exact"))


class Phases:
    """Seconds that the phases of a run take on the clock: `with phases("encode"): ...`. A phase that comes again adds up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began
