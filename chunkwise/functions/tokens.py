"""Texts as bytes, code points and tokens of byte pairs."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def small_batches(spark: SparkSession, rows: int = 1024, size: str = "16m") -> None:
    """Bound the rows and bytes of an Arrow batch handed to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def characters(text: Column) -> Column:
    """Characters of a text, in order."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def code_points(text: Column) -> Column:
    return F.transform(characters(text), lambda c: F.ascii(c))


def from_code_points(points: Column) -> Column:
    """The text of an array of code points below 2 ** 16 that are no surrogates; the way back from code_points()."""
    return F.array_join(F.transform(points, lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 4, "0")), "UTF-16BE")), "")


def bos_shift(rows: DataFrame, group: list[str], order: str, token: str, bos: int = 0) -> DataFrame:
    """Each token with the one before it in `previous`, bos before the first."""
    return rows.withColumn("previous", F.lag(token, 1, bos).over(Window.partitionBy(*group).orderBy(order)))


def with_previous(points: Column, bos: int = 0) -> Column:
    """Pairs (previous, symbol) of an array, without an exchange."""
    return F.arrays_zip(F.slice(F.concat(F.array(F.lit(bos)), points), F.lit(1), F.size(points)).alias("previous"), points.alias("symbol"))


def windows(position: Column, size: int = 1024) -> tuple[Column, Column]:
    """Number of the tumbling window that holds a position, and the place in it."""
    return F.floor(position / size).cast("int"), F.pmod(position, F.lit(size)).cast("int")


def padded(tokens: Column, length: Column, bos: int = 0) -> Column:
    """Tokens up to a common length."""
    return F.concat(tokens, F.array_repeat(F.lit(bos), F.greatest(length - F.size(tokens), F.lit(0)).cast("int")))


def truncated(data: Column, n: Column) -> Column:
    return data.substr(F.lit(1), n)


def valid_utf8(data: Column) -> Column:
    """Bytes as text, with a replacement character for what isn't UTF-8. Lossy; the codec keeps to bytes."""
    return F.make_valid_utf8(data)


#: Symbols that are counted together; bounds a worker's memory, however long a text is.
AT_ONCE = 1 << 18
#: Sizes of a table of counts, against those that are sorted.
TABLE = 1 << 20


def _distinct(points: np.ndarray) -> np.ndarray:
    """Distinct code points, by a table of them instead of a sort."""
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    return np.flatnonzero(seen)


def _counted(key: np.ndarray, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of numbers below `sizes`, packed in one key, and how often each comes."""
    whole = int(np.prod(sizes, dtype=object))
    if whole <= TABLE:
        n = np.bincount(key, minlength=whole)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    parts = []
    for size in reversed(sizes):
        parts.append(key % size)
        key = key // size
    return parts[::-1], n


def symbol_counts(rows: DataFrame, group: list[str], text: str, pairs: bool = False, bos: int = 0) -> DataFrame:
    """(group..., [previous,] symbol, n): how often each code point, or each byte of a binary column, occurs in each group; with `pairs`, behind which other.

    Counted within portions of a batch, so that what is shuffled are counts and never characters. Null texts have none.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in group) + ", previous int" * pairs + ", symbol int, n long"
    binary = kinds[text] == "binary"

    def portions(texts) -> Iterator[tuple[list[tuple[int, bool]], list[np.ndarray]]]:
        """Pieces of texts, (row, whether it begins there), with their symbols; some AT_ONCE of them together."""
        held, symbols, many = [], [], 0
        for row, text in enumerate(texts):
            raw = text.as_py()
            if not raw:
                continue
            own = np.frombuffer(raw if binary else raw.encode("utf-32-le", "surrogatepass"), np.uint8 if binary else np.uint32)
            for at in range(0, len(own), AT_ONCE):
                # what goes on from an earlier piece has its last symbol before it
                held.append((row, at == 0))
                symbols.append(own[max(at - pairs, 0) : at + AT_ONCE])
                many += len(symbols[-1])
                if many >= AT_ONCE:
                    yield held, symbols
                    held, symbols, many = [], [], 0
        if held:
            yield held, symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(0x110000 + 1, np.int64)
        for batch in batches:
            index: dict = {}
            keys = [index.setdefault(k, len(index)) for k in zip(*(batch.column(c).to_pylist() for c in range(len(group))))] if group else [index.setdefault((), 0)] * batch.num_rows
            names = list(index)
            for held, pieces in portions(batch.column(len(group))):
                joined = np.concatenate(pieces)
                known = np.union1d(np.flatnonzero(np.bincount(joined, minlength=256)) if binary else _distinct(joined), [bos])
                code[known] = np.arange(len(known))
                lengths = np.array([len(x) for x in pieces])
                who, which = np.unique([keys[row] for row, _ in held], return_inverse=True)
                key, sizes = np.repeat(which, lengths), (len(who), len(known))
                own = code[joined]
                if pairs:
                    before = np.concatenate(([0], own[:-1]))
                    first = np.cumsum(lengths) - lengths
                    begins = np.array([begin for _, begin in held])
                    before[first[begins]] = code[bos]
                    key, sizes = key * len(known) + before, (len(who), len(known), len(known))
                key = key * len(known) + own
                if pairs:
                    key = np.delete(key, first[~begins])
                (at, *symbols), n = _counted(key, sizes)
                columns = [pa.array([names[k][c] for k in who[at].tolist()], batch.schema.field(c).type) for c in range(len(group))]
                columns += [pa.array(known[x].astype(np.int32)) for x in symbols]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=[*group, *["previous"] * pairs, "symbol", "n"])

    small_batches(rows.sparkSession)
    by = [*group, *["previous"] * pairs, "symbol"]
    return rows.select(*group, text).mapInArrow(run, schema).groupBy(*by).agg(F.sum("n").alias("n"))


#: How byte-level vocabularies cut a text into words before pairs are merged.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def _encoding(path: str):
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def bpe_encode(path: str) -> Callable[..., Column]:
    """A function of a text column: ids of its byte pairs under the vocabulary of ranks at `path`, which all executors have to reach. Null for null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pd.Series) -> pd.Series:
        own = _encoding(path)
        return pd.Series([None if t is None else own.encode_ordinary(t) for t in text], dtype=object)

    return encode


def bpe_decode(path: str) -> Callable[..., Column]:
    """The way back: ids to text, with a replacement character for what isn't UTF-8."""

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        own = _encoding(path)
        return pd.Series([None if x is None else own.decode_bytes([int(i) for i in x]).decode("utf-8", "replace") for x in ids], dtype=object)

    return decode
