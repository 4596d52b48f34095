"""Splitting into chunks that end between characters, and scanning blobs for their entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import framing
from ..functions.sizing import chunk_size

CHUNK = "chunk_idx int, byte_start long, orig_len int, data binary"


def chunk_ends(data: Column, size: Column) -> Column:
    """Ends of greedy chunks of at most `size` bytes; one that would end within a character ends before it.

    Up to three bytes are looked back. If that leaves nothing, or the bytes aren't UTF-8, the chunk ends at its size, so that
    splitting always goes on and concatenation always gives the input.
    """
    n = F.octet_length(data)
    size = F.greatest(size, F.lit(1))
    within = lambda at: F.hex(F.substring(data, at + 1, F.lit(1))).between("80", "BF")

    def step(acc, _):
        begin = acc["pos"]
        end = F.least(begin + size, n).cast("int")
        fits = lambda k: (end - k > begin) & ~within(end - k)
        snapped = F.when((end >= n) | ~within(end), end)
        for k in (1, 2, 3):
            snapped = snapped.when(fits(k), end - k)
        end = snapped.otherwise(end)
        return F.when(begin < n, F.struct(end.alias("pos"), F.concat(acc["ends"], F.array(end)).alias("ends"))).otherwise(acc)

    # every chunk has size - 3 bytes at least, where size is more than 3
    most = (n / F.greatest(size - 3, F.lit(1))).cast("int") + 1
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("ends"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step)["ends"]


def split(docs: DataFrame, keys: list[str], data: str, pin: int | None = None) -> DataFrame:
    """(keys..., chunk_idx, byte_start, orig_len, data) of each chunk, without an exchange and without Python.

    Texts count as UTF-8. Null and empty values have no chunks. Rows that repeat are split one by one.
    """
    raw = F.col(data).cast("binary")
    rows = docs.select(*keys, raw.alias("__raw")).withColumn("__ends", chunk_ends(F.col("__raw"), chunk_size(F.octet_length("__raw"), pin=pin).cast("int")))
    begin = lambda i: F.when(i == 0, 0).otherwise(F.element_at("__ends", F.greatest(i, F.lit(1))))
    chunk = lambda end, i: F.struct(begin(i).alias("begin"), (end - begin(i)).alias("n"), F.col("__raw").substr(begin(i) + 1, end - begin(i)).alias("data"))
    # pieces are cut before they become rows, so that no row carries its whole text along
    rows = rows.where("__raw is not null and octet_length(__raw) > 0").select(*keys, F.posexplode(F.transform("__ends", chunk)).alias("chunk_idx", "__chunk"))
    return rows.select(*keys, "chunk_idx", F.col("__chunk.begin").cast("long").alias("byte_start"), F.col("__chunk.n").alias("orig_len"), F.col("__chunk.data").alias("data"))


def split_bytes(raw: bytes, size: int) -> list[bytes]:
    """The same in Python."""
    out, at, size = [], 0, max(size, 1)
    while at < len(raw):
        end = min(at + size, len(raw))
        if end < len(raw):
            end = next((e for e in range(end, max(end - 4, at), -1) if raw[e] & 0xC0 != 0x80), end)
        out.append(raw[at:end])
        at = end
    return out


def split_arrow(docs: DataFrame, key: str, data: str, pin: int | None = None) -> DataFrame:
    """As split(), for values of many thousand chunks, on which a fold over an array would be slow. One key column of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = 0
                for i, part in enumerate(split_bytes(raw or b"", pin or max(65_536, -(-len(raw or b"") // 512)))):
                    rows.append((k, i, at, len(part), part))
                    at += len(part)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=[key, "chunk_idx", "byte_start", "orig_len", "data"])

    return docs.select(F.col(key).cast("long").alias(key), F.col(data).cast("binary").alias("__raw")).mapInArrow(run, f"{key} long, {CHUNK}")


def scan_entries(blobs: DataFrame, key: str, blob: str, *more: str) -> DataFrame:
    """(key, more..., chunk_idx, orig_len, comp_len, payload, error) of each entry of each blob; a damaged blob has one row with the reason in error."""
    kinds = dict(blobs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, raw in enumerate(batch.column(1)):
                raw = raw.as_py()
                if raw is None:
                    continue
                try:
                    head = framing.unpack_header(raw)
                    rows += [(k, i, n, len(p), p, None) for i, (n, p, _) in enumerate(framing.entries(raw, head.n_chunks))]
                except framing.Damaged as e:
                    rows.append((k, None, None, None, None, str(e)))
            at, *found = zip(*rows) if rows else [()] * 6
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, *range(2, 2 + len(more)))]
            types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(found, types))], names=[key, *more, "chunk_idx", "orig_len", "comp_len", "payload", "error"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in more) + ", " * bool(more)
    return blobs.select(F.col(key).cast("long").alias(key), blob, *more).mapInArrow(run, f"{key} long, {schema}chunk_idx int, orig_len long, comp_len long, payload binary, error string")


def contexts(data: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of chunks one behind the other, and the context of each: the last `order` bytes, with zeros before a chunk's first."""
    x = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.array([len(raw) for raw in data], np.int64)
    first, ctx = np.cumsum(lengths) - lengths, np.zeros(len(x), np.int32)
    for k in range(1, order + 1):
        before = np.concatenate((np.zeros(k, np.uint8), x))[: len(x)].astype(np.int32)
        for j in range(k):
            before[first[lengths > j] + j] = 0
        ctx |= before << 8 * (k - 1)
    return x, ctx


def byte_counts(data: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, n) over chunks."""
    x, ctx = contexts(data, order)
    key = ctx << 8 | x
    if order < 2:
        n = np.bincount(key, minlength=1 << 8 * (order + 1))
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    key = key.astype(np.int64)
    return key >> 8, key & 255, n
