"""Checksums of joined pieces from those of the pieces."""

from __future__ import annotations

from functools import lru_cache


def _times(matrix: tuple[int, ...], x: int) -> int:
    out, k = 0, 0
    while x:
        if x & 1:
            out ^= matrix[k]
        x >>= 1
        k += 1
    return out


def _squared(m: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(_times(m, row) for row in m)


@lru_cache(64)
def _zeros(power: int) -> tuple[int, ...]:
    """What 2 ** power zero bytes do to a checksum, as a matrix over bits."""
    if power:
        return _squared(_zeros(power - 1))
    bit = (0xEDB88320, *(1 << k for k in range(31)))
    return _squared(_squared(_squared(bit)))


@lru_cache(1024)
def _shift(length: int) -> tuple[int, ...]:
    out = tuple(1 << k for k in range(32))
    for power in range(length.bit_length()):
        if length >> power & 1:
            out = tuple(_times(_zeros(power), row) for row in out)
    return out


def crc32_joined(first: int, second: int, length: int) -> int:
    """CRC-32 of a followed by b, from that of a, that of b, and the length of b."""
    return _times(_shift(length), first) ^ second
