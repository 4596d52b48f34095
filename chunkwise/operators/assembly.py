"""Blobs put together from chunks, and one blob from the blobs of parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import framing
from ..functions.framing import LAYOUT, NO_CRC


def in_order(data: str, place: str) -> Column:
    """An aggregate: binary values of a group, one behind the other by their places. Each byte is copied once; null values are left out."""
    return F.coalesce(F.expr(f"listagg(`{data}`) within group (order by `{place}`)"), F.lit(b""))


def blobs(encoded: DataFrame, keys: list[str], model_id: int, crc32=None) -> DataFrame:
    """(keys..., blob, n_chunks, original_len): a header and the chunks' entries, in order. Without crc32 (a column for each key), the header says so."""
    encoded = encoded.withColumn("__entry", framing.entry(F.col("orig_len"), F.col("payload")))
    aggregates = [in_order("__entry", "chunk_idx").alias("__body"), F.count("*").alias("n_chunks"), F.sum("orig_len").cast("long").alias("original_len")]
    if crc32 is not None:
        aggregates.append(F.first(crc32).alias("__crc"))
    rows = encoded.groupBy(*keys).agg(*aggregates)
    crc, flags = (F.col("__crc"), F.lit(0)) if crc32 is not None else (F.lit(0), F.lit(NO_CRC))
    head = framing.header(F.col("original_len"), F.col("n_chunks"), crc, F.lit(model_id), flags)
    return rows.select(*keys, F.concat(head, "__body").alias("blob"), "n_chunks", "original_len")


def master(parts: DataFrame, keys: list[str], part: str = "part", blob: str = "blob") -> DataFrame:
    """One blob from those of parts, in order: headers off, their lengths and chunks added up, no checksum of the whole.

    Parts that aren't blobs of one model make the result null.
    """
    rows = parts.select(*keys, F.col(part).alias("__part"), F.col(blob).alias("__blob"))
    rows = rows.withColumns({"__ok": framing.header_valid(F.col("__blob")), "__n": framing.header_field(F.col("__blob"), "n_chunks"), "__len": framing.header_field(F.col("__blob"), "original_len"), "__model": framing.header_field(F.col("__blob"), "model_id")})
    rows = rows.withColumn("__body", F.expr(f"substring(__blob, {LAYOUT.size + 1})"))
    done = rows.groupBy(*keys).agg(in_order("__body", "__part").alias("__all"), F.sum("__n").cast("long").alias("n_chunks"), F.sum("__len").cast("long").alias("original_len"), F.min("__model").alias("__model"), F.max("__model").alias("__other"), F.bool_and("__ok").alias("__ok"))
    head = framing.header(F.col("original_len"), F.col("n_chunks"), F.lit(0), F.col("__model"), F.lit(NO_CRC))
    return done.select(*keys, F.when(F.col("__ok") & (F.col("__model") == F.col("__other")), F.concat(head, "__all")).alias("blob"), "n_chunks", "original_len")
