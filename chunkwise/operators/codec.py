"""The codec: count models fitted as DataFrames, chunks encoded and decoded in narrow stages, many in lockstep.

A model of order k holds counts of each byte after each k bytes. Contexts that were not seen share the distribution of all bytes. The
model's id is the checksum of its counts; what is encoded under one is refused under another. Other models can take its place: whatever
is a ChunkCodec, such as a StepModel, which asks a function for the distribution of each next symbol.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coder, framing, tokens
from ..functions.cdf import cumulative, from_probabilities
from ..sources import storage
from .assembly import in_order
from .chunking import byte_counts, contexts, split

ORDER = 2
#: Chunks that go through the coder together, and bytes of them, each as long as the longest; they bound a worker's memory.
LOCKSTEP, LOCKSTEP_BYTES = 4096, 1 << 23
ENCODED = "chunk_idx int, byte_start long, orig_len int, comp_len int, crc32 long, payload binary"


class ChunkCodec(Protocol):
    """What encode() and decode() need of a model. It travels to the executors pickled."""

    model_id: int

    def compress(self, data: list[bytes]) -> list[bytes]:
        """Payloads, each a pair of lengths (framing.PAIR: bytes, symbols) and the coded bits."""

    def restore(self, payloads: list[bytes]) -> list[bytes]: ...


@dataclass(frozen=True)
class Model:
    """contexts: those seen, in order. bounds: a row for each, and one more for all others."""

    order: int
    contexts: np.ndarray
    bounds: np.ndarray
    model_id: int

    @cached_property
    def row(self) -> np.ndarray:
        """The row of each context."""
        out = np.full(1 << 8 * self.order, len(self.contexts), np.int64)
        out[self.contexts] = np.arange(len(self.contexts))
        return out

    @cached_property
    def lookup(self) -> coder.Lookup:
        return coder.Lookup(self.bounds)

    def rows(self, ctx: np.ndarray) -> np.ndarray:
        return self.row[ctx]

    def next(self, ctx: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return (ctx << 8 | symbol) & ((1 << 8 * self.order) - 1)

    def compress(self, data: list[bytes]) -> list[bytes]:
        return encode_chunks(data, self)

    def restore(self, payloads: list[bytes]) -> list[bytes]:
        return decode_chunks(payloads, self)


@dataclass(frozen=True)
class StepModel:
    """A model that is a function: step(state, last symbol) -> (probabilities of all symbols, next state).

    The state before the first symbol is None, and the symbol before the first is `bos`. tokenize and detokenize turn bytes into symbols and back,
    exactly; without them the symbols are the bytes. The function has to give the same numbers wherever it runs. One symbol at a time.
    """

    step: Callable[[Any, int], tuple[np.ndarray, Any]]
    model_id: int
    bos: int = 0
    tokenize: Callable[[bytes], list[int]] | None = None
    detokenize: Callable[[list[int]], bytes] | None = None

    def compress(self, data: list[bytes]) -> list[bytes]:
        out = []
        for raw in data:
            symbols = self.tokenize(raw) if self.tokenize else list(raw)
            state, last, to = None, self.bos, coder.Encoder()
            for s in symbols:
                p, state = self.step(state, last)
                bounds = from_probabilities(p)[0]
                to.put(int(bounds[s]), int(bounds[s + 1]))
                last = s
            out.append(framing.PAIR.pack(len(raw), len(symbols)) + to.finish())
        return out

    def restore(self, payloads: list[bytes]) -> list[bytes]:
        out = []
        for p in payloads:
            n, count = framing.PAIR.unpack_from(p)
            state, last, symbols, source = None, self.bos, [], coder.Decoder(p[framing.PAIR.size :])
            for _ in range(count):
                shares, state = self.step(state, last)
                last = source.take(from_probabilities(shares)[0])
                symbols.append(last)
            raw = self.detokenize(symbols) if self.detokenize else bytes(symbols)
            if len(raw) != n:
                raise framing.Damaged("bytes and symbols don't agree")
            out.append(raw)
        return out


@dataclass(frozen=True)
class FunctionCodec:
    """Functions in place of a model: each(chunk) -> coded bytes and back(coded) -> chunk, or their forms for lists, which are preferred."""

    model_id: int
    each: Callable[[bytes], bytes] | None = None
    back: Callable[[bytes], bytes] | None = None
    each_of: Callable[[list[bytes]], list[bytes]] | None = None
    back_of: Callable[[list[bytes]], list[bytes]] | None = None

    def compress(self, data: list[bytes]) -> list[bytes]:
        coded = self.each_of(data) if self.each_of else [self.each(x) for x in data]
        return [framing.PAIR.pack(len(raw), len(raw)) + x for raw, x in zip(data, coded, strict=True)]

    def restore(self, payloads: list[bytes]) -> list[bytes]:
        coded = [p[framing.PAIR.size :] for p in payloads]
        data = list(self.back_of(coded)) if self.back_of else [self.back(x) for x in coded]
        if [len(x) for x in data] != [framing.PAIR.unpack_from(p)[0] for p in payloads]:
            raise framing.Damaged("a chunk isn't as long as it was")
        return data


def save_model(model: Model, url: str) -> None:
    """Write a count model, so that what was encoded under it can be read by others."""
    out = io.BytesIO()
    np.savez_compressed(out, order=model.order, contexts=model.contexts, bounds=model.bounds, model_id=model.model_id)
    storage.write(url, out.getvalue())


def saved_model(url: str, model_id: int | None = None) -> Model:
    """Read what save_model() wrote; ValueError if it isn't the model with that id."""
    with np.load(io.BytesIO(storage.read_all(url))) as x:
        model = Model(int(x["order"]), x["contexts"], x["bounds"], int(x["model_id"]))
    if model_id is not None and model.model_id != model_id:
        raise ValueError(f"{url} holds model {model.model_id}, not {model_id}")
    return model


def build_model(order: int, ctx: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Model:
    by = np.lexsort((symbol, ctx))
    ctx, symbol, n = (np.asarray(x, np.int64)[by] for x in (ctx, symbol, n))
    contexts, row = np.unique(ctx, return_inverse=True)
    counts = np.zeros((len(contexts) + 1, 256), np.int64)
    np.add.at(counts, (row, symbol), n)
    counts[-1] = counts[:-1].sum(axis=0)
    name = zlib.crc32(np.stack((ctx, symbol, n)).tobytes(), order) if len(n) else order
    return Model(order, contexts, cumulative(counts).astype(np.int32), name)


def count_model(chunks: DataFrame, order: int = ORDER) -> DataFrame:
    """(ctx, symbol, n): how often each byte follows each context, over all chunks. Counted in batches, then added up."""

    small_batches(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            ctx, symbol, n = byte_counts([x for x in batch.column(0).to_pylist() if x], order)
            for k, v in zip((ctx << 8 | symbol).tolist(), n.tolist()):
                total[k] = total.get(k, 0) + v
            if len(total) > 1 << 20:
                yield _counted(total)
                total = {}
        yield _counted(total)

    return chunks.select("data").mapInArrow(run, "ctx long, symbol int, n long").groupBy("ctx", "symbol").agg(F.sum("n").alias("n"))


def _counted(total: dict[int, int]) -> pa.RecordBatch:
    key = np.array(list(total), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key >> 8), pa.array((key & 255).astype(np.int32)), pa.array(list(total.values()), pa.int64())], names=["ctx", "symbol", "n"])


def load_model(counts: DataFrame, order: int = ORDER) -> Model:
    """To the driver come at most 256 ** (order + 1) counts, whatever the size of the corpus."""
    if not 0 <= order <= 2:
        raise ValueError("models go up to order 2")
    pdf = counts.select("ctx", "symbol", "n").toPandas()
    return build_model(order, pdf["ctx"].to_numpy(), pdf["symbol"].to_numpy(), pdf["n"].to_numpy())


def fit(chunks: DataFrame, order: int = ORDER) -> Model:
    return load_model(count_model(chunks, order), order)


def _together(lengths: list[int]) -> Iterator[slice]:
    """Chunks that go through the coder together."""
    first, longest = 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, n)
        if i > first and (i - first == LOCKSTEP or longest * (i - first + 1) > LOCKSTEP_BYTES):
            yield slice(first, i)
            first, longest = i, n
    if lengths:
        yield slice(first, len(lengths))


def encode_chunks(data: list[bytes], model: Model) -> list[bytes]:
    """Payloads: lengths in bytes and symbols, and the bits."""
    out: list[bytes] = []
    flat = np.ascontiguousarray(model.bounds, np.int32).ravel()
    for some in map(data.__getitem__, _together([len(x) for x in data])):
        x, ctx = contexts(some, model.order)
        at = model.rows(ctx) * model.bounds.shape[1] + x
        bits = coder.encode_flat(flat[at], flat[at + 1], np.array([len(raw) for raw in some], np.int64))
        out += [framing.PAIR.pack(len(raw), len(raw)) + b for raw, b in zip(some, bits)]
    return out


def decode_chunks(payloads: list[bytes], model: Model) -> list[bytes]:
    out: list[bytes] = []
    if any(len(p) < framing.PAIR.size for p in payloads):
        raise framing.Damaged("a payload is too short")
    lengths = [framing.PAIR.unpack_from(p) for p in payloads]
    if any(a != b for a, b in lengths):
        raise framing.Damaged("bytes and symbols don't agree")
    for some in _together([n for n, _ in lengths]):
        own = np.array([n for n, _ in lengths[some]])
        state = _States(model, len(own))
        symbols = coder.decode_many([p[framing.PAIR.size :] for p in payloads[some]], own, model.bounds, state, state.first, model.lookup)
        out += [s.tobytes() for s in symbols]
    return out


class _States:
    """Contexts of streams that are decoded in lockstep, as rows of the model."""

    def __init__(self, model: Model, count: int):
        self.model, self.ctx = model, np.zeros(count, np.int64)
        self.first = int(model.rows(np.zeros(1, np.int64))[0])

    def __call__(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if not self.model.order:
            return row
        live = len(symbol)
        self.ctx[:live] = self.model.next(self.ctx[:live], symbol)
        return self.model.rows(self.ctx[:live])


def encode(chunks: DataFrame, model: ChunkCodec, keys: list[str]) -> DataFrame:
    """Chunks (keys..., chunk_idx, byte_start, orig_len, data) with payloads instead of data, and a checksum. A narrow stage."""
    sent = chunks.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    n = len(keys)
    schema = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(sent.value)
        for batch in batches:
            data = batch.column(n + 3).to_pylist()
            payloads = own.compress(data)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n + 3], pa.array([len(p) for p in payloads], pa.int32()), pa.array([zlib.crc32(d) for d in data], pa.int64()), pa.array(payloads, pa.binary())],
                names=[*keys, "chunk_idx", "byte_start", "orig_len", "comp_len", "crc32", "payload"],
            )

    return chunks.select(*keys, "chunk_idx", "byte_start", "orig_len", "data").mapInArrow(run, f"{schema}, {ENCODED}")


def decode(encoded: DataFrame, model: ChunkCodec, keys: list[str]) -> DataFrame:
    """(keys..., chunk_idx, byte_start, orig_len, data, crc_ok) of encoded chunks. A narrow stage.

    A chunk whose lengths or checksum don't agree has crc_ok false.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    n = len(keys)
    schema = ", ".join(f"{k} {dict(encoded.dtypes)[k]}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(sent.value)
        for batch in batches:
            payloads, lengths, crcs = (batch.column(n + k).to_pylist() for k in (4, 2, 3))
            sound = [i for i, (p, m) in enumerate(zip(payloads, lengths)) if p is not None and len(p) >= 8 and framing.PAIR.unpack_from(p)[0] == m]
            data: list[bytes | None] = [None] * len(payloads)
            for i, d in zip(sound, _restored([payloads[i] for i in sound], own)):
                data[i] = d
            ok = [d is not None and (c is None or zlib.crc32(d) == c) for d, c in zip(data, crcs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 3], pa.array(data, pa.binary()), pa.array(ok)], names=[*keys, "chunk_idx", "byte_start", "orig_len", "data", "crc_ok"])

    return encoded.select(*keys, "chunk_idx", "byte_start", "orig_len", "crc32", "payload").mapInArrow(run, f"{schema}, chunk_idx int, byte_start long, orig_len int, data binary, crc_ok boolean")


def _restored(payloads: list[bytes], model: ChunkCodec) -> list[bytes | None]:
    """Chunks of a batch; where some payload is damaged, one by one, so that the others are read."""
    try:
        return list(model.restore(payloads))
    except (framing.Damaged, ValueError, IndexError):
        out: list[bytes | None] = []
        for p in payloads:
            try:
                out += model.restore([p])
            except (framing.Damaged, ValueError, IndexError):
                out.append(None)
        return out


def compress(docs: DataFrame, keys: list[str], data: str, model: ChunkCodec | None = None, pin: int | None = None, order: int = ORDER) -> tuple[DataFrame, ChunkCodec]:
    """Encoded chunks of every row, and the model; without one, it is fitted to these rows."""
    small_batches(docs.sparkSession)
    chunks = split(docs, keys, data, pin)
    model = model or fit(chunks, order)
    return encode(chunks, model, keys), model


def decompress(encoded: DataFrame, model: ChunkCodec, keys: list[str]) -> DataFrame:
    """(keys..., data, crc_ok): chunks decoded and put together in order. Rows that repeat their keys must be told apart by another key."""
    chunks = decode(encoded, model, keys)
    return chunks.groupBy(*keys).agg(in_order("data", "chunk_idx").alias("data"), F.bool_and("crc_ok").alias("crc_ok"))


def small_batches(spark: SparkSession) -> None:
    tokens.small_batches(spark, LOCKSTEP)
