"""From counts to exact integer distributions; no floating-point number is involved, so encoder and decoder agree by construction.

Every symbol of a context gets a width of n * (TOTAL - V) div sum + 1, and the most frequent one (the lowest on a tie) takes what is left, so
that widths add up to TOTAL. Where nothing was counted, all symbols weigh the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRECISION = 24
TOTAL = 1 << PRECISION


def integer_cdf(counts: DataFrame, context: list[str], symbol: str = "symbol", n: str = "n") -> DataFrame:
    """(context..., symbol, lo, width) from (context..., symbol, n): the share of each symbol, and the shares below it.

    A context needs fewer than TOTAL symbols. One window exchange by context; its two sorts are within partitions. Null symbols are a symbol of
    their own, before all others; contexts without rows have none.
    """
    whole = Window.partitionBy(*context)
    rows = counts.select(*context, symbol, F.col(n).cast("long").alias("__n"))
    rows = rows.withColumns({"__sum": F.sum("__n").over(whole), "__v": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn("__w", F.expr(f"if(__sum > 0, __n * ({TOTAL} - __v) div __sum, ({TOTAL} - __v) div __v) + 1"))
    rows = rows.withColumns({"__rest": F.lit(TOTAL) - F.sum("__w").over(whole), "__top": F.row_number().over(whole.orderBy(F.desc("__n"), F.asc(symbol)))})
    rows = rows.withColumn("width", (F.col("__w") + F.when(F.col("__top") == 1, F.col("__rest")).otherwise(0)).cast("long"))
    below = whole.orderBy(F.asc(symbol)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("lo", F.coalesce(F.sum("width").over(below), F.lit(0)).cast("long")).select(*context, symbol, "lo", "width")


def cumulative(counts: np.ndarray) -> np.ndarray:
    """The same for rows of counts over all V symbols: rows of V + 1 bounds, from 0 to TOTAL."""
    counts = np.atleast_2d(np.asarray(counts, np.int64))
    v = counts.shape[1]
    if v >= TOTAL:
        raise ValueError("more symbols than the precision holds")
    counts = np.where(counts.sum(axis=1, keepdims=True) > 0, counts, 1)
    width = counts * (TOTAL - v) // counts.sum(axis=1, keepdims=True) + 1
    width[np.arange(len(width)), counts.argmax(axis=1)] += TOTAL - width.sum(axis=1)
    return np.concatenate((np.zeros((len(width), 1), np.int64), np.cumsum(width, axis=1)), axis=1)


def from_probabilities(p: np.ndarray) -> np.ndarray:
    """Bounds from rows of probabilities: normalised, floored, at least 1 each, the rest to the likeliest."""
    p = np.atleast_2d(np.asarray(p, np.float64))
    v = p.shape[1]
    width = np.floor(p / p.sum(axis=1, keepdims=True) * (TOTAL - v)).astype(np.int64) + 1
    width[np.arange(len(width)), p.argmax(axis=1)] += TOTAL - width.sum(axis=1)
    if (width < 1).any():
        raise ValueError("a symbol without width")
    return np.concatenate((np.zeros((len(width), 1), np.int64), np.cumsum(width, axis=1)), axis=1)
