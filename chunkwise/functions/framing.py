"""The container's framing as column expressions, and the same in Python for readers and writers.

Header, 37 bytes, big end first: magic, version, model id, tokenizer id, adapter id, adapter version, flags, original length,
number of chunks, CRC-32 of the original. An entry is (original length, compressed length) and an encoded chunk, which begins with
(original length, symbols).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC, VERSION, TOKENIZER = b"CKWS", 1, 0x42595445
#: There's no checksum of the whole; chunks have their own in the index.
NO_CRC = 1
LAYOUT = struct.Struct(">4sBIIIHHQII")
FIELDS = [("magic", 4), ("blob_version", 1), ("model_id", 4), ("tokenizer_id", 4), ("adapter_id", 4), ("adapter_version", 2), ("flags", 2), ("original_len", 8), ("n_chunks", 4), ("crc32", 4)]
PAIR = struct.Struct(">II")


class Damaged(ValueError):
    """Bytes that aren't what the format says."""


@dataclass(frozen=True)
class Header:
    original_len: int
    n_chunks: int
    crc32: int = 0
    model_id: int = 0
    flags: int = 0
    adapter_id: int = 0
    adapter_version: int = 0

    def pack(self) -> bytes:
        return LAYOUT.pack(MAGIC, VERSION, self.model_id, TOKENIZER, self.adapter_id, self.adapter_version, self.flags, self.original_len, self.n_chunks, self.crc32)


def unpack_header(data: bytes) -> Header:
    if len(data) < LAYOUT.size:
        raise Damaged(f"{len(data)} bytes are too short for a header of {LAYOUT.size}")
    magic, version, model, tokenizer, adapter, adapter_version, flags, length, chunks, crc = LAYOUT.unpack_from(data)
    if magic != MAGIC:
        raise Damaged(f"unknown magic {magic!r}")
    if version != VERSION or tokenizer != TOKENIZER:
        raise Damaged(f"version {version} with tokenizer {tokenizer} can't be read")
    return Header(length, chunks, crc, model, flags, adapter, adapter_version)


def entries(data: bytes, n: int, at: int = LAYOUT.size):
    """(original length, payload, byte offset) of each entry."""
    for _ in range(n):
        if at + PAIR.size > len(data):
            raise Damaged("the blob ends before its entries do")
        length, packed = PAIR.unpack_from(data, at)
        if at + PAIR.size + packed > len(data):
            raise Damaged("the blob ends within an entry")
        yield length, data[at + PAIR.size : at + PAIR.size + packed], at
        at += PAIR.size + packed
    if at != len(data):
        raise Damaged(f"{len(data) - at} bytes after the last entry")


def big_endian(number: Column, n: int) -> Column:
    """A number in n bytes."""
    return F.unhex(F.lpad(F.hex(number.cast("long")), 2 * n, "0"))


def header(original_len: Column, n_chunks: Column, crc32: Column, model_id: Column | None = None, flags: Column | None = None) -> Column:
    zero = F.lit(0)
    values = [None, F.lit(VERSION), zero if model_id is None else model_id, F.lit(TOKENIZER), zero, zero, zero if flags is None else flags, original_len, n_chunks, crc32]
    return F.concat(F.lit(MAGIC), *(big_endian(v, n) for v, (_, n) in zip(values[1:], FIELDS[1:])))


def header_field(blob: Column, name: str) -> Column:
    """A field of a header; null where the blob is shorter than one. Magic as text in hexadecimal digits."""
    at = 1
    for field, n in FIELDS:
        if field == name:
            digits = F.hex(F.substring(blob, at, n))
            value = digits if name == "magic" else F.conv(digits, 16, 10).cast("decimal(20,0)" if n == 8 else "long")
            return F.when(F.octet_length(blob) >= LAYOUT.size, value)
        at += n
    raise ValueError(f"no field {name}")


def header_valid(blob: Column) -> Column:
    return F.coalesce((header_field(blob, "magic") == MAGIC.hex().upper()) & (header_field(blob, "blob_version") == VERSION) & (header_field(blob, "tokenizer_id") == TOKENIZER), F.lit(False))


def entry(original_len: Column, payload: Column) -> Column:
    return F.concat(big_endian(original_len, 4), big_endian(F.octet_length(payload), 4), payload)
