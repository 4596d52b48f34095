"""A 32-bit range coder with carry-free renormalisation, bit for bit as specified, one stream at a time or many in lockstep.

A stream is most significant bit first, padded with zeros to whole bytes; a reader sees zeros beyond its end. Encoder is the
plain form and can be halted and resumed; encode_many and decode_many give the same bits, with numpy over all streams at each step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .cdf import PRECISION, TOTAL

HALF, QUARTER, MASK = 1 << 31, 1 << 30, (1 << 32) - 1


@dataclass
class Encoder:
    low: int = 0
    high: int = MASK
    pending: int = 0
    bits: list[int] = field(default_factory=list)

    def put(self, lo: int, hi: int) -> None:
        """Narrow down to [lo, hi) of TOTAL."""
        if not 0 <= lo < hi <= TOTAL:
            raise ValueError("no width to encode")
        span = self.high - self.low + 1
        self.high = self.low + (span * hi >> PRECISION) - 1
        self.low += span * lo >> PRECISION
        while True:
            if self.high < HALF:
                self._emit(0)
            elif self.low >= HALF:
                self._emit(1)
                self.low, self.high = self.low - HALF, self.high - HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                self.pending += 1
                self.low, self.high = self.low - QUARTER, self.high - QUARTER
            else:
                return
            self.low, self.high = self.low << 1, self.high << 1 | 1

    def _emit(self, bit: int) -> None:
        self.bits.append(bit)
        self.bits += [1 - bit] * self.pending
        self.pending = 0

    def finish(self) -> bytes:
        self.pending += 1
        self._emit(int(self.low >= QUARTER))
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


class Decoder:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
        self.low, self.high, self.value = 0, MASK, 0
        for _ in range(32):
            self.value = self.value << 1 | self._next()

    def _next(self) -> int:
        self.at += 1
        return int(self.bits[self.at - 1]) if self.at <= len(self.bits) else 0

    def take(self, bounds: np.ndarray) -> int:
        """The symbol whose bounds hold the value."""
        span = self.high - self.low + 1
        target = ((self.value - self.low + 1) * TOTAL - 1) // span
        symbol = int(np.searchsorted(bounds, target, side="right")) - 1
        self.high = self.low + (span * int(bounds[symbol + 1]) >> PRECISION) - 1
        self.low += span * int(bounds[symbol]) >> PRECISION
        while True:
            if self.high < HALF:
                less = 0
            elif self.low >= HALF:
                less = HALF
            elif self.low >= QUARTER and self.high < HALF + QUARTER:
                less = QUARTER
            else:
                return symbol
            self.low, self.high = self.low - less << 1, self.high - less << 1 | 1
            self.value = self.value - less << 1 | self._next()


def encode(bounds: np.ndarray, symbols) -> bytes:
    """Symbols under one row of bounds each, or one row for all."""
    bounds, coder = np.asarray(bounds), Encoder()
    for i, s in enumerate(symbols):
        row = bounds if bounds.ndim == 1 else bounds[i]
        coder.put(int(row[s]), int(row[s + 1]))
    return coder.finish()


def decode(bounds: np.ndarray, data: bytes, n: int) -> list[int]:
    bounds, coder = np.asarray(bounds), Decoder(data)
    return [coder.take(bounds if bounds.ndim == 1 else bounds[i]) for i in range(n)]


def _length(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2 ** 32, 0 for 0: what the exponent of a double says."""
    return ((x + 0.5).view(np.int64) >> 52) - 1022


def _settled(base: np.ndarray, top: np.ndarray) -> np.ndarray:
    """How many bits both bounds leave: those on which they agree, and those that stay open beside the middle. At most 27, as a range has 2 ** 30 or more and a symbol 2 ** -24 of it or more."""
    n = 32 - _length(base ^ top)
    # after the leading bit, as long as base has 1 and top has 0
    m = 32 - _length((base << n & ~(top << n)) << 1 & MASK ^ MASK)
    return n + np.minimum(m, 31)


def _live(own: np.ndarray, longest: int) -> list[int]:
    """How many streams have a symbol at each step, the longest being first."""
    return np.searchsorted(-own, -np.arange(longest), side="left").tolist()


def encode_many(lo: list[np.ndarray], hi: list[np.ndarray]) -> list[bytes]:
    """A stream for each list of bounds, all in lockstep."""
    flat = [np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in (lo, hi)]
    return encode_flat(*flat, np.array([len(x) for x in lo], np.int64))


def encode_flat(lo: np.ndarray, hi: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The same for streams whose bounds lie one behind the other.

    With bits taken off as they settle, a stream is the sum of what each symbol adds to the lower bound, each as far down as bits are settled by then. So the steps only
    keep what is added and how many bits settle; the sums, with what they carry, are made at the end.
    """
    order = np.argsort(-lengths, kind="stable")
    count, longest, own = len(lengths), int(lengths.max(initial=0)), lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    at = first + order  # each stream has a place more, for its end
    added, settled = np.zeros(len(lo) + count, np.uint32), np.zeros(len(lo) + count, np.uint8)
    low, span = np.zeros(count, np.int64), np.full(count, MASK + 1, np.int64)
    for t, live in enumerate(_live(own, longest)):
        width, j = span[:live], first[:live] + t
        ra, rb = width * lo[j] >> PRECISION, width * hi[j] >> PRECISION
        base = low[:live] + ra
        k = _settled(base, base + (rb - ra - 1))
        low[:live], span[:live] = base << k & (HALF - 1), rb - ra << k
        j = at[:live] + t
        added[j], settled[j] = ra, k
    added[at + own] = np.where(low >= QUARTER, HALF, QUARTER) - low  # up to the bits that tell it apart
    out, edges = [], np.concatenate(([0], np.cumsum(lengths + 1)))
    for a, b in _stretches(lengths + 1, SUMMED):
        out += _summed(added[edges[a] : edges[b]], settled[edges[a] : edges[b]], lengths[a:b] + 1)
    return out


#: Symbols whose bits are put together at once.
SUMMED = 1 << 18


def _stretches(sizes: np.ndarray, most: int):
    """(first, end) of stretches of `most` in all, or of one that is larger."""
    a, held = 0, 0
    for b, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield a, b
            a, held = b, 0
        held += size
    if len(sizes):
        yield a, len(sizes)


def _summed(added: np.ndarray, settled: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The streams of what symbols add; the last of each is its end."""
    ends = np.cumsum(size) - 1
    before = np.cumsum(settled, dtype=np.int64) - settled
    before -= np.repeat(before[ends - size + 1], size)
    total = before[ends] + 2  # bits of a stream
    room = (total + 46) // 16 + 1
    base = np.cumsum(room) - room
    # sums in digits of 16 bits, over three of which a number of 32 lies
    place = np.repeat(base, size) + (before >> 4)
    wide = added.astype(np.int64) << 16 - (before & 15)
    digits = np.zeros(int(room.sum()) + 3, np.int64)
    for k, shift in enumerate((32, 16, 0)):
        digits += np.bincount(place + k, wide >> shift & 0xFFFF, minlength=len(digits)).astype(np.int64)
    while (carry := digits >> 16).any():
        digits &= 0xFFFF
        digits[:-1] += carry[1:]
    raw = digits.astype(">u2").tobytes()
    return [raw[2 * at : 2 * at - (-bits // 8)] for at, bits in zip(base.tolist(), total.tolist())]


#: Entries of a table of symbols by context and the first bits of a place.
TABLE = 1 << 19


class Lookup:
    """Symbols by context and place in it: a table by the place's first bits, and a search where these don't tell."""

    def __init__(self, bounds: np.ndarray):
        self.wide, self.flat = bounds.shape[1], np.ascontiguousarray(bounds).ravel()
        self.keys = (bounds + (np.arange(len(bounds), dtype=np.int64) << PRECISION + 1)[:, None])[:, :-1].ravel()
        self.bits = int(np.clip(np.log2(TABLE / len(bounds)), 0, 14))
        self.shift = PRECISION - self.bits
        first = (np.arange(len(bounds), dtype=np.int64) << PRECISION + 1)[:, None] + (np.arange(1 << self.bits, dtype=np.int64) << self.shift)
        low, high = (np.searchsorted(self.keys, x.ravel(), side="right") - 1 for x in (first, first + (1 << self.shift) - 1))
        self.table = np.where(low == high, low, -1).astype(np.int32)

    def __call__(self, row: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Places of the symbols among all rows of symbols."""
        at = self.table[(row << self.bits) + (target >> self.shift)]
        open_ = np.flatnonzero(at < 0)
        if len(open_):
            at[open_] = np.searchsorted(self.keys, (row[open_] << PRECISION + 1) + target[open_], side="right") - 1
        return at


def decode_many(data: list[bytes], lengths: np.ndarray, bounds: np.ndarray, context, first: int = 0, lookup: Lookup | None = None) -> list[np.ndarray]:
    """Symbols of each stream. bounds: a row for each context; context(state, symbol) gives the next rows, from `first` on. Lookup(bounds) may be given, if it is there."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    count, longest = len(data), int(lengths.max(initial=0))
    own = lengths[order]
    if not count:
        return []
    raw = [data[i] + bytes(16) for i in order]
    base = np.cumsum([len(x) for x in raw]) - np.array([len(x) for x in raw], np.int64)
    room = np.array([len(x) * 8 - 64 for x in raw], np.int64)
    joined = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    word = joined[:-4] << 32 | joined[1:-3] << 24 | joined[2:-2] << 16 | joined[3:-1] << 8 | joined[4:]
    lookup = lookup or Lookup(np.asarray(bounds))
    flat, symbols = lookup.flat, lookup.wide - 1
    # the range by its lower bound and extent, the value by how far above the bound it is: what settles is taken off both alike
    low, span, at = np.zeros(count, np.int64), np.full(count, MASK + 1, np.int64), np.full(count, 32, np.int64)
    value = word[base] >> 8
    state = np.full(count, first, np.int64)
    out = np.zeros((longest, count), np.uint8 if symbols <= 256 else np.int32)
    for t, live in enumerate(_live(own, longest)):
        width, row = span[:live], state[:live]
        place = lookup(row, ((value[:live] + 1) * TOTAL - 1) // width)
        s = place - row * symbols
        j = place + row  # rows of bounds have one more
        ra, rb = width * flat[j] >> PRECISION, width * flat[j + 1] >> PRECISION
        under = low[:live] + ra
        k = _settled(under, under + (rb - ra - 1))
        low[:live], span[:live] = under << k & (HALF - 1), rb - ra << k
        p = np.minimum(at[:live], room[:live])
        fresh = word[base[:live] + (p >> 3)] >> (40 - (at[:live] & 7) - k) & (np.int64(1) << k) - 1
        value[:live] = (value[:live] - ra << k) | fresh
        at[:live] += k
        out[t, :live] = s
        state[:live] = context(row, s)
    out, done = np.ascontiguousarray(out.T), [None] * count
    for k, i in enumerate(order.tolist()):
        done[i] = out[k, : own[k]]
    return done
