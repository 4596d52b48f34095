"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, group: list[str], order: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """All columns, and in `name` the sum of `value` over the rows of the group that come before, by `order`, a column of whole numbers.

    Stretches of `width` numbers are added up first, before anything is shuffled; a window over the stretches' sums gives where each begins, and a window within
    a stretch does the rest. So no task holds a whole group, however large. Rows alike in order get one total each, in no particular order. Null orders come first.
    """
    rows = rows.withColumn("__stretch", F.floor(F.col(order) / width).cast("long"))
    sums = rows.groupBy(*group, "__stretch").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*group).orderBy(F.asc_nulls_first("__stretch")).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__stretch").alias("__s"), F.coalesce(before, F.lit(0)).alias("__start"))
    same = F.col("__stretch").eqNullSafe(F.col("__s"))
    for k, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"__g{k}"))
    within = F.sum(value).over(Window.partitionBy(*group, "__stretch").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1))
    out = rows.join(starts, same).withColumn(name, F.col("__start") + F.coalesce(within, F.lit(0)))
    return out.drop("__stretch", "__s", "__start", *(f"__g{k}" for k in range(len(group))))
