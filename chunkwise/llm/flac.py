"""FLAC media columns: frames are parsed, Rice residuals and linear predictors decoded, checksums verified, PCM blocks written.

Unary parts of Rice codes are followed from one bit to the next over positions found by numpy; remainders of a whole
partition are gathered at once, and predictors run in lockstep over all subframes of a batch of files. Short streams go through all of
this in lockstep, frame by frame. An encoder is here as well, for tests and for media columns made of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac_lanes
from .common import small_batches, table

RATE, BITS, BLOCK = 16_000, 16, 16
#: The query's signals are running sums over 2 ** RUNNING.
RUNNING = 4
BLOCKS = "media_id long, block int, first_sample long, n_samples int, sample_rate int, channels int, bits int, byte_offset long, byte_length int, crc_ok boolean, pcm binary, error string"
#: Bits of a stream whose one bits are listed together; bounds memory only.
WINDOW = 1 << 16
_SIZES = [0, 192, 576, 1152, 2304, 4608, -8, -16, *(256 << k for k in range(8))]
_RATES = [0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000]
_DEPTHS = [0, 8, 12, -1, 16, 20, 24, 32]
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, width: int) -> list[int]:
    out, top, mask = [], 1 << (width - 1), (1 << width) - 1
    for c in range(256):
        c <<= width - 8
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ b]
    return c


class Broken(ValueError):
    """The stream isn't as the format says."""


class _Bits:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.end = data, pos, len(data) * 8
        self.bits, self.base, self.after = np.unpackbits(np.frombuffer(data, np.uint8)), 0, []

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.pos, self.pos + n
        if b > self.end:
            raise Broken("the stream ends within a frame")
        self.pos = b
        return (int.from_bytes(self.data[a >> 3 : (b + 7) >> 3], "big") >> (-b & 7)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def many(self, count: int, n: int) -> np.ndarray:
        """`count` signed numbers of n bits."""
        if self.pos + count * n > self.end:
            raise Broken("the stream ends within a frame")
        x = self.bits[self.pos : self.pos + count * n].reshape(count, n).astype(np.int64) @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64)) if n else np.zeros(count, np.int64)
        self.pos += count * n
        return np.where(x >> (n - 1), x - (1 << n), x) if n else x

    def _look(self, p: int, size: int) -> None:
        """List, for each bit from p on, where the next one bit is; -1 if it isn't in sight."""
        part = self.bits[p : p + size]
        at = np.where(part, np.arange(p, p + len(part)), np.iinfo(np.int64).max)
        near = np.minimum.accumulate(at[::-1])[::-1]
        self.base, self.after = p, np.where(near == np.iinfo(np.int64).max, -1, near).tolist()

    def one(self, p: int) -> int:
        """Position of the first one bit at or after p."""
        size = WINDOW
        while True:
            k = p - self.base
            if 0 <= k < len(self.after) and self.after[k] >= 0:
                return self.after[k]
            if p >= self.end or size > 2 * self.end + WINDOW:
                raise Broken("the stream ends within a code")
            self._look(p, size)
            size *= 2

    def unary(self) -> int:
        e = self.one(self.pos)
        n, self.pos = e - self.pos, e + 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        ends, p, step = np.empty(count, np.int64), self.pos, k + 1
        for i in range(count):
            j = p - self.base
            e = self.after[j] if 0 <= j < len(self.after) else -1
            if e < 0:
                e = self.one(p)
            ends[i] = e
            p = e + step
        if p > self.end:
            raise Broken("the stream ends within a code")
        starts = np.concatenate(([self.pos], ends[:-1] + step)) if count else ends
        value = (ends - starts) << k
        if k and count:
            value |= self.bits[(ends + 1)[:, None] + np.arange(k)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64))
        self.pos = p
        return (value >> 1) ^ -(value & 1)


@dataclass
class _Subframe:
    """values: warm-up samples, then residuals, until restore() has put samples in place."""

    values: np.ndarray
    coefficients: list[int] = field(default_factory=list)
    shift: int = 0
    wasted: int = 0


@dataclass
class _Frame:
    first: int
    size: int
    rate: int
    bits: int
    assignment: int
    start: int
    end: int
    good: bool
    subframes: list[_Subframe]


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    method = bits.take(2)
    if method > 1:
        raise Broken("a residual of an unknown kind")
    width, parts = 4 + method, bits.take(4)
    if size % (1 << parts) or (size >> parts) < order:
        raise Broken("partitions that don't fit the block")
    out = []
    for k in range(1 << parts):
        count, parameter = (size >> parts) - (order if not k else 0), bits.take(width)
        if parameter == (1 << width) - 1:
            out.append(bits.many(count, bits.take(5)))
        else:
            out.append(bits.rice(count, parameter))
    return np.concatenate(out)


def _subframe(bits: _Bits, size: int, depth: int) -> _Subframe:
    if bits.take(1):
        raise Broken("a subframe without its padding bit")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        depth -= wasted
    if depth < 1:
        raise Broken("a subframe of no depth")
    if kind == 0:
        return _Subframe(np.full(size, bits.signed(depth), np.int64), wasted=wasted)
    if kind == 1:
        return _Subframe(bits.many(size, depth), wasted=wasted)
    if 8 <= kind <= 12:
        order = kind - 8
        warm = bits.many(min(order, size), depth)
        return _Subframe(np.concatenate((warm, _residual(bits, size, order))), FIXED[order], 0, wasted)
    if kind >= 32:
        order = kind - 31
        warm, precision = bits.many(min(order, size), depth), bits.take(4) + 1
        if precision == 16:
            raise Broken("a predictor of unknown precision")
        shift = bits.signed(5)
        if shift < 0:
            raise Broken("a predictor with a negative shift")
        own = bits.many(order, precision).tolist()
        return _Subframe(np.concatenate((warm, _residual(bits, size, order))), own, shift, wasted)
    raise Broken("a subframe of a reserved kind")


def _coded_number(bits: _Bits) -> int:
    first = bits.take(8)
    more = 0
    while more < 8 and first >> (7 - more) & 1:
        more += 1
    if more in (1, 8):
        raise Broken("a frame number that isn't well formed")
    value = first & (0x7F >> more)
    for _ in range(more - 1 if more else 0):
        b = bits.take(8)
        if b >> 6 != 2:
            raise Broken("a frame number that isn't well formed")
        value = value << 6 | b & 63
    return value


@dataclass
class Info:
    least: int
    most: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes
    audio: int


def stream_info(data: bytes) -> Info:
    """What the stream says of itself, and where its frames begin."""
    if data[:4] != b"fLaC":
        raise Broken("not a FLAC stream")
    at, info = 4, None
    while True:
        if at + 4 > len(data):
            raise Broken("the stream ends within its metadata")
        kind, length = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + length]
        if kind & 127 == 0 and len(body) >= 34:
            x = int.from_bytes(body[10:18], "big")
            info = Info(int.from_bytes(body[:2], "big"), int.from_bytes(body[2:4], "big"), x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1, body[18:34], 0)
        at += 4 + length
        if kind & 128:
            break
    if info is None or at > len(data):
        raise Broken("a stream without its description")
    info.audio = at
    return info


def _frame(bits: _Bits, info: Info, data: bytes) -> _Frame:
    start = bits.pos >> 3
    if bits.take(15) != 0b111111111111100:
        raise Broken("no frame where one should begin")
    variable, size, rate, assignment, depth = bits.take(1), bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    if bits.take(1) or not size or rate == 15 or assignment > 10 or depth == 3:
        raise Broken("a frame header with reserved values")
    number = _coded_number(bits)
    size = bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else _SIZES[size]
    rate = bits.take(8) * 1000 if rate == 12 else bits.take(16) if rate == 13 else bits.take(16) * 10 if rate == 14 else _RATES[rate] or info.rate
    at = bits.pos >> 3
    if crc8(data[start:at]) != bits.take(8):
        raise Broken("a frame header with a wrong checksum")
    depth = _DEPTHS[depth] or info.bits
    channels = assignment + 1 if assignment < 8 else 2
    subframes = [_subframe(bits, size, depth + ((assignment, c) in ((8, 1), (9, 0), (10, 1)))) for c in range(channels)]
    bits.pos += -bits.pos & 7
    at = bits.pos >> 3
    good = crc16(data[start:at]) == bits.take(16)
    return _Frame(number if variable else number * (info.most if info.least == info.most or not info.least else size), size, rate, depth, assignment, start, bits.pos >> 3, good, subframes)


def parse(data: bytes) -> tuple[Info, list[_Frame | tuple[int, str]]]:
    """The frames of a stream, in order; where one is broken, (byte, reason), and the search goes on behind it."""
    info = stream_info(data)
    bits, out = _Bits(data, info.audio * 8), []
    while bits.pos >> 3 < len(data):
        start = bits.pos >> 3
        try:
            frame = _frame(bits, info, data)
            if not frame.good:
                raise Broken("a frame with a wrong checksum")
            out.append(frame)
        except Broken as e:
            out.append((start, str(e)))
            at = start + 1
            while (at := data.find(b"\xff", at)) >= 0:
                if at + 1 < len(data) and data[at + 1] & 0xFE == 0xF8 and _header_ok(data, at):
                    break
                at += 1
            if at < 0:
                break
            bits.pos = at * 8
    return info, out


def _header_ok(data: bytes, at: int) -> bool:
    """Whether some checksum fits a frame header that begins here."""
    return any(at + n < len(data) and crc8(data[at : at + n]) == data[at + n] for n in range(5, 16))


def restore(subframes: list[_Subframe]) -> None:
    """Run the predictors, in lockstep over all subframes; afterwards values are samples."""
    todo = sorted((s for s in subframes if s.coefficients and len(s.values) > len(s.coefficients)), key=lambda s: len(s.values))
    for at in range(0, len(todo), 4096):
        some = todo[at : at + 4096]
        deep, wide, n = max(len(s.coefficients) for s in some), len(some[-1].values), len(some)
        lengths, orders = np.array([len(s.values) for s in some]), np.array([len(s.coefficients) for s in some])
        x, taps = np.zeros((wide + deep, n), np.int64), np.zeros((deep, n), np.int64)
        for j, s in enumerate(some):
            x[deep : deep + lengths[j], j] = s.values
            taps[deep - orders[j] :, j] = s.coefficients[::-1]
        shift = np.array([s.shift for s in some])
        for t in range(int(orders.min()), wide):
            live = (t >= orders) & (t < lengths)
            x[deep + t] += np.where(live, (taps * x[t : t + deep]).sum(axis=0) >> shift, 0)
        for j, s in enumerate(some):
            s.values = x[deep : deep + lengths[j], j]
    for s in subframes:
        s.coefficients, s.values, s.wasted = [], s.values << s.wasted, 0


def samples(frame: _Frame) -> np.ndarray:
    """A row for each sample, a column for each channel; restore() comes before."""
    x = [s.values for s in frame.subframes]
    if frame.assignment == 8:
        x[1] = x[0] - x[1]
    elif frame.assignment == 9:
        x[0] = x[0] + x[1]
    elif frame.assignment == 10:
        mid = (x[0] << 1) | (x[1] & 1)
        x = [(mid + x[1]) >> 1, (mid - x[1]) >> 1]
    return np.stack(x, axis=1)


def pcm(values: np.ndarray, bits: int) -> bytes:
    """Interleaved samples, little end first, in whole bytes."""
    wide = (bits + 7) // 8
    return np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(*values.shape, 8)[..., :wide].tobytes()


def decode(data: bytes) -> tuple[Info, np.ndarray]:
    """All samples of a sound stream; Broken where a frame isn't sound."""
    info, frames = parse(data)
    for f in frames:
        if isinstance(f, tuple):
            raise Broken(f[1])
    restore([s for f in frames for s in f.subframes])
    return info, np.concatenate([samples(f) for f in frames]) if frames else np.zeros((0, info.channels), np.int64)


class _Writer:
    def __init__(self):
        self.parts: list[np.ndarray] = []

    def put(self, value: int, n: int) -> None:
        if n:
            value &= (1 << n) - 1
            raw = np.unpackbits(np.frombuffer(value.to_bytes((n + 7) // 8, "big"), np.uint8))
            self.parts.append(raw[len(raw) - n :])

    def many(self, values: np.ndarray, n: int) -> None:
        if n:
            self.parts.append(((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel())

    def rice(self, values: np.ndarray, k: int) -> None:
        folded = np.where(values < 0, -2 * values - 1, 2 * values)
        q = folded >> k
        ends = np.cumsum(q + 1 + k) - k - 1
        out = np.zeros(int(ends[-1]) + k + 1 if len(ends) else 0, np.uint8)
        out[ends] = 1
        for j in range(k):
            out[ends + 1 + j] = (folded >> (k - 1 - j)) & 1
        self.parts.append(out)

    def bytes(self) -> bytes:
        return np.packbits(np.concatenate(self.parts)).tobytes()


def _utf8(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    tail = []
    more = 1
    while n >= 1 << (6 - more):
        tail.append(128 | n & 63)
        n >>= 6
        more += 1
    return bytes([(0xFF00 >> more) & 0xFF | n, *tail[::-1]])


def _best_rice(residual: np.ndarray) -> int:
    folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
    top = min(14, max(0, int(folded.max(initial=0)).bit_length()))
    return min(range(top + 1), key=lambda k: int((folded >> k).sum()) + k * len(folded))


def _lpc(x: np.ndarray, order: int, precision: int = 12) -> tuple[list[int], int] | None:
    """Quantised predictor by Levinson and Durbin; None where there's nothing to predict."""
    w = x * np.hanning(len(x) + 2)[1:-1]
    r = np.array([w[k:] @ w[: len(w) - k] for k in range(order + 1)])
    if r[0] <= 0:
        return None
    a, e = np.zeros(order), r[0]
    for i in range(order):
        k = (r[i + 1] - a[:i] @ r[i:0:-1]) / e
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        e *= 1 - k * k
        if e <= 0:
            return None
    top = float(np.abs(a).max())
    if top <= 0:
        return None
    shift = int(np.clip(precision - 2 - np.floor(np.log2(top)), 0, 15))
    q = np.clip(np.round(a * (1 << shift)), -(1 << precision - 1), (1 << precision - 1) - 1).astype(np.int64)
    return q.tolist(), shift


def _write_subframe(out: _Writer, x: np.ndarray, depth: int, order: int, parts: int) -> None:
    if (x == x[0]).all():
        out.put(0, 8)
        out.put(int(x[0]), depth)
        return
    wasted = 0
    while not (x & 1).any():
        x, wasted, depth = x >> 1, wasted + 1, depth - 1
    n = len(x)
    options = []
    for k in range(min(5, n)):
        options.append((np.diff(x, k) if k else x, k, None))
    if order and n > order and (own := _lpc(x, order)):
        taps = np.array(own[0])
        windows = np.lib.stride_tricks.sliding_window_view(x, order)[:-1]
        options.append((x[order:] - ((windows[:, ::-1] * taps).sum(axis=1) >> own[1]), order, own))
    residual, k, own = min(options, key=lambda o: np.abs(o[0]).sum() + (20 + 12 * o[1] if o[2] else 0))
    while parts and (n % (1 << parts) or (n >> parts) < k):
        parts -= 1
    rice, at = [], 0
    for j in range(1 << parts):
        size = (n >> parts) - (k if not j else 0)
        rice.append((residual[at : at + size], _best_rice(residual[at : at + size])))
        at += size
    cost = sum(int((np.abs(r) * 2 >> p).sum()) + len(r) * (p + 1) for r, p in rice) + k * depth
    flag = (wasted > 0)
    kind = 1 if cost >= n * depth else 31 + k if own else 8 + k
    out.put(kind << 1 | flag, 8)
    if flag:
        out.put(1, wasted)
    if kind == 1:
        out.many(x, depth)
        return
    out.many(x[:k], depth)
    if own:
        out.put(11, 4), out.put(own[1], 5), out.many(np.array(own[0]), 12)
    out.put(0, 2), out.put(parts, 4)
    for r, p in rice:
        out.put(p, 4), out.rice(r, p)


def encode(values: np.ndarray, rate: int = RATE, bits: int = BITS, block: int = BLOCK, order: int = 4, parts: int = 1, stereo: int = 0) -> bytes:
    """A stream of the samples (rows) of all channels (columns). stereo: 0 for channels by themselves, 8, 9 or 10 as frames name it."""
    import hashlib

    values = np.asarray(values, np.int64)
    values = values.reshape(len(values), -1) if values.size else values.reshape(0, 1)
    n, channels = values.shape
    head = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | n).to_bytes(8, "big") + hashlib.md5(pcm(values, bits)).digest()
    out = [b"fLaC", bytes([128]), len(head).to_bytes(3, "big"), head]
    for number, at in enumerate(range(0, n, block)):
        x = [values[at : at + block, c] for c in range(channels)]
        size = len(x[0])
        front = bytes([0xFF, 0xF8, 7 << 4, (stereo or channels - 1) << 4]) + _utf8(number) + (size - 1).to_bytes(2, "big")
        front += bytes([crc8(front)])
        if stereo == 8:
            x[1] = x[0] - x[1]
        elif stereo == 9:
            x[0] = x[0] - x[1]
        elif stereo == 10:
            x = [(x[0] + x[1]) >> 1, x[0] - x[1]]
        body = _Writer()
        for c in range(channels):
            _write_subframe(body, x[c], bits + ((stereo, c) in ((8, 1), (9, 0), (10, 1))), order, parts)
        frame = front + body.bytes()
        out += [frame, crc16(frame).to_bytes(2, "big")]
    return b"".join(out)


_SCHEMA = pa.schema([("media_id", pa.int64()), ("block", pa.int32()), ("first_sample", pa.int64()), ("n_samples", pa.int32()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("byte_offset", pa.int64()), ("byte_length", pa.int32()), ("crc_ok", pa.bool_()), ("pcm", pa.binary()), ("error", pa.string())])


def _lanes(media: list, data: list[bytes], infos: list[Info]) -> tuple[list[pa.RecordBatch], np.ndarray]:
    """Blocks of short streams in lockstep, and which of the streams that can't be done for."""
    lanes = flac_lanes.Lanes(data, [i.audio for i in infos], [i.least for i in infos], [i.most for i in infos], [i.rate for i in infos], [i.bits for i in infos])
    out = []
    for f in lanes.frames():
        n = len(f.lane)
        if not n:
            continue
        wide, blobs = (f.bits + 7) // 8, []
        little = np.ascontiguousarray(f.samples.astype("<i8")).view(np.uint8).reshape(*f.samples.shape, 8)
        if len({*zip(wide.tolist(), f.size.tolist(), f.channels.tolist())}) == 1:
            whole, step = little[:, : f.size[0], : f.channels[0], : wide[0]].tobytes(), int(f.size[0] * f.channels[0] * wide[0])
            blobs = [whole[k * step : (k + 1) * step] for k in range(n)]
        else:
            blobs = [little[k, : f.size[k], : f.channels[k], : wide[k]].tobytes() for k in range(n)]
        columns = [[media[k] for k in f.lane.tolist()], f.number, f.first, f.size, f.rate, f.channels, f.bits, f.start, f.end - f.start, np.ones(n, bool), blobs, pa.nulls(n, pa.string())]
        out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA))
    return out, lanes.bad


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, single, short = [], [], []
        for media, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not data:
                continue
            try:
                info = stream_info(data)
                (short if len(data) <= flac_lanes.SHORT else single).append((media, data, info))
            except Broken as e:
                rows.append((media, None, None, 0, None, None, None, 0, len(data), False, None, str(e)))
        portion = np.cumsum([len(d) for _, d, _ in short]) // flac_lanes.TOGETHER
        for k in np.unique(portion):
            some = [short[i] for i in np.flatnonzero(portion == k)]
            blocks, bad = _lanes(*map(list, zip(*some)))
            yield from blocks
            single += [some[i] for i in np.flatnonzero(bad)]
        parsed = [(media, *parse(data)) for media, data, _ in single]
        restore([s for _, _, frames in parsed for f in frames if isinstance(f, _Frame) for s in f.subframes])
        for media, info, frames in parsed:
            for k, f in enumerate(frames):
                if isinstance(f, tuple):
                    rows.append((media, k, None, 0, info.rate, info.channels, info.bits, f[0], None, False, None, f[1]))
                else:
                    rows.append((media, k, f.first, f.size, f.rate, len(f.subframes), f.bits, f.start, f.end - f.start, True, pcm(samples(f), f.bits), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_SCHEMA), _SCHEMA.types)], schema=_SCHEMA)


def decode_blocks(media: DataFrame, id_col: str = "media_id", data_col: str = "flac") -> DataFrame:
    """A row for each frame of each stream, with its samples and where they stand.

    (media_id, block, first_sample, n_samples, sample_rate, channels, bits, byte_offset, byte_length, crc_ok, pcm, error). pcm holds the samples,
    channels interleaved, little end first, in whole bytes. first_sample and byte_offset allow to seek: from the frame number, so they hold behind
    a broken frame too. A frame with a wrong checksum or form has crc_ok false, no pcm and the reason in error, and decoding
    goes on at the next sound header. A value that is no FLAC stream has one such row with a null block.

    Null and empty values have no rows; null ids stay null. Repeated rows are decoded one by one. Other columns are ignored, and
    an empty table gives an empty result. A stream is decoded by one task, whole.
    """
    small_batches(media.sparkSession)
    return media.select(F.col(id_col).cast("long").alias("media_id"), F.col(data_col).cast("binary").alias("flac")).mapInArrow(_decode_batches, BLOCKS)


def seek(blocks: DataFrame, start: int, end: int) -> DataFrame:
    """The sound blocks that hold samples from start up to but not including end."""
    return blocks.where(f"crc_ok and first_sample < {int(end)} and first_sample + n_samples > {int(start)}")


def encode_many(signals: list[np.ndarray], rate: int = RATE, bits: int = BITS, block: int = BLOCK, order: int = 4, parts: int = 1) -> list[bytes]:
    """encode() for many signals of one channel, blocks of one size together."""
    import hashlib

    cuts = [(s, k, x[at : at + block]) for s, x in enumerate(signals) for k, at in enumerate(range(0, len(x), block))]
    sizes = np.array([len(x) for _, _, x in cuts], np.int64)
    frames: list[bytes] = [b""] * len(cuts)
    fronts: dict[tuple[int, int], bytes] = {}
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        bodies = flac_lanes.write_subframes(np.stack([cuts[i][2] for i in rows]), bits, order, parts)
        for i, body in zip(rows.tolist(), bodies):
            if body is None:
                one = _Writer()
                _write_subframe(one, cuts[i][2], bits, order, parts)
                body = one.bytes()
            key = (cuts[i][1], int(size))
            if key not in fronts:
                front = bytes([0xFF, 0xF8, 7 << 4, 0]) + _utf8(key[0]) + (key[1] - 1).to_bytes(2, "big")
                fronts[key] = front + bytes([crc8(front)])
            frames[i] = fronts[key] + body
    sums = flac_lanes.crc16_of(frames) if frames else []
    out = []
    for x in signals:
        head = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | bits - 1 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(pcm(x[:, None], bits)).digest()
        out.append([b"fLaC", bytes([128]), len(head).to_bytes(3, "big"), head])
    for (s, _, _), frame, crc in zip(cuts, frames, sums):
        out[s] += [frame, crc.to_bytes(2, "big")]
    return [b"".join(x) for x in out]


def _encoder(running: int | None):
    """(id, levels) -> (id, stream); running: signals are running sums, shifted down by so many bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = batch.column(1)
            there = np.flatnonzero(levels.is_valid().to_numpy(zero_copy_only=False))
            values = levels.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(levels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))[there]
            signals = np.split(values, ends[:-1]) if len(there) else []
            if running is not None:
                signals = [np.clip(np.cumsum(x) >> running, -32768, 32767) for x in signals]
            data: list[bytes | None] = [None] * batch.num_rows
            for i, x in zip(there.tolist(), encode_many(signals)):
                data[i] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["media_id", "flac"])

    return run


def media_column(signals: DataFrame, id_col: str = "vec_id", signal_col: str = "embedding", running: int | None = None) -> DataFrame:
    """(media_id, flac): each array of numbers from -1 to 1 as a FLAC stream of one channel of 16 bits.

    With `running` the signal is the running sum of the numbers over 2 ** running, which is smooth, as sound is. A null array is a null stream, null numbers
    are silence, numbers beyond the range are cut off.
    """
    small_batches(signals.sparkSession)
    level = lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x.cast("double") * 32767 + 0.5))).cast("int")
    return signals.select(F.col(id_col).cast("long").alias("media_id"), F.transform(signal_col, level).alias("level")).mapInArrow(_encoder(running), "media_id long, flac binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as steps of signals: written as a media column of FLAC streams, and decoded to blocks."""
    blocks = decode_blocks(media_column(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), running=RUNNING))
    return blocks.select("media_id", "block", "first_sample", "n_samples", "sample_rate", "channels", "bits", "crc_ok", F.hex("pcm").alias("pcm_hex"))


SQL = f"""
WITH s AS (
  SELECT vec_id, unnest(range(len(embedding))) AS i,
         unnest(list_transform(embedding, lambda x: greatest(-32768, least(32767, floor(x::DOUBLE * 32767 + 0.5)))::INTEGER)) AS v
  FROM embeddings
), r AS (SELECT vec_id, i, greatest(-32768, least(32767, floor(sum(v) OVER (PARTITION BY vec_id ORDER BY i) / {1 << RUNNING}.0)))::INTEGER AS v FROM s),
u AS (SELECT vec_id, i, ((v + 65536) % 65536)::INTEGER AS u FROM r)
SELECT vec_id AS media_id, (i // {BLOCK})::INTEGER AS block, min(i)::BIGINT AS first_sample, count(*)::INTEGER AS n_samples, {RATE}::INTEGER AS sample_rate, 1::INTEGER AS channels,
       {BITS}::INTEGER AS bits, true AS crc_ok, string_agg(printf('%02X%02X', u % 256, u // 256), '' ORDER BY i) AS pcm_hex
FROM u GROUP BY vec_id, i // {BLOCK}
"""
