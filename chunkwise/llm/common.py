"""Helpers shared by the corpus operators: reading, tokenising, hashing and cutting lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = r"[^\p{L}\p{N}]+"
#: Rows of an Arrow batch handed to Python; bounds a worker's memory for long texts.
BATCH_ROWS = 1000
#: Characters whose words are hashed together; bounds the memory of that.
AT_ONCE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str = "16m") -> None:
    """Bound the rows and bytes of an Arrow batch for operators that take whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only a local master may do without one; it gets a temporary folder, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chunkwise-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder in the shared one, deleted when the driver's program ends."""
    if not _made:
        atexit.register(_delete_made)
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_made() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:  # else the session has ended, and with it the way to delete
            delete(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by cut() that is not read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in name:
            delete(spark, name)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet."""
    out = []
    for name in names:
        while name.lower() in {c.lower() for c in df.columns}:
            name = f"_{name}"
        out.append(name)
    return out


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), SEPARATORS, " "), " "), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


SQL_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _in_words() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    out = np.zeros(0x110000, bool)
    for plane in (0, 1, 2, 3):
        at = range(plane << 16, plane + 1 << 16)
        out[at.start : at.stop] = [unicodedata.category(chr(c))[0] in "LN" for c in at]
    return out


_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_SEED, _ALL = 42, (1 << 64) - 1


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash after eight more bytes."""
    return _turned(h ^ _turned(word * np.uint64(_P2), 31) * np.uint64(_P1), 27) * np.uint64(_P1) + np.uint64(_P4)


def _stripes(raw: bytes) -> int:
    """The hash of 32 bytes or more after its whole stripes of 32, one by one."""
    turn = lambda x, k: (x << k | x >> 64 - k) & _ALL
    lanes = [(_SEED + _P1 + _P2) & _ALL, (_SEED + _P2) & _ALL, _SEED, (_SEED - _P1) & _ALL]
    words = np.frombuffer(raw, "<u8", len(raw) // 32 * 4).tolist()
    for at in range(0, len(words), 4):
        lanes = [turn(v + w * _P2 & _ALL, 31) * _P1 & _ALL for v, w in zip(lanes, words[at : at + 4])]
    h = sum(turn(v, k) for v, k in zip(lanes, (1, 7, 12, 18))) & _ALL
    for v in lanes:
        h = ((h ^ turn(v * _P2 & _ALL, 31) * _P1 & _ALL) * _P1 + _P4) & _ALL
    return h


def _xxhash64(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 of stretches of bytes, as Spark has it, many at once. 8 bytes behind the last have to be there."""
    eight, four = (np.ndarray(len(raw) - n + 1, f"<u{n}", raw, strides=(1,)) for n in (8, 4))
    h = np.full(len(start), _SEED + _P5, np.uint64)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = _stripes(raw[start[i] : start[i] + size[i]].tobytes())
    h += size.astype(np.uint64)
    at, left = start + (size & ~31), size & 31
    for k in (8, 16, 24):
        more = np.flatnonzero(left >= k)
        if not len(more):
            break
        h[more] = _mixed(h[more], eight[at[more] + (k - 8)])
    at, left = at + (left & ~7), left & 7
    more = np.flatnonzero(left >= 4)
    h[more] = _turned(h[more] ^ four[at[more]].astype(np.uint64) * np.uint64(_P1), 23) * np.uint64(_P2) + np.uint64(_P3)
    at, left = at + (left & 4), left & 3
    for k in (1, 2, 3):
        more = np.flatnonzero(left >= k)
        h[more] = _turned(h[more] ^ raw[at[more] + (k - 1)].astype(np.uint64) * np.uint64(_P5), 11) * np.uint64(_P1)
    h = (h ^ h >> np.uint64(33)) * np.uint64(_P2)
    h = (h ^ h >> np.uint64(29)) * np.uint64(_P3)
    return h ^ h >> np.uint64(32)


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that word_hashes() has of a column of texts, and offsets, without a pattern or an array of words. Null has no words."""
    hashes, counts, held, many = [], [], [], 0

    def done() -> None:
        ends = np.cumsum([len(t) for t in held])
        joined = "".join(held)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode() + bytes(8), np.uint8)
        inside = np.concatenate(([False], _in_words()[points], [False]))
        edge = inside[1:] != inside[:-1]
        edge[ends[:-1]] |= inside[ends[:-1]] & inside[ends[:-1] + 1]
        # where one text's word touches the next one's, an edge is both end and start
        first, last = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
        counts.append(np.diff(np.searchsorted(first, np.concatenate(([0], ends)))))
        if len(raw) - 8 != len(points):
            place = np.concatenate(([0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))))
            first, last = place[first], place[last]
        hashes.append(_xxhash64(raw, first, last - first))

    for text in texts.to_pylist():
        held.append(text.lower() if text else "")
        many += len(held[-1])
        if many >= AT_ONCE:
            done()
            held, many = [], 0
    if held:
        done()
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    return np.concatenate(hashes).view(np.int64), np.concatenate(([0], np.cumsum(np.concatenate(counts))))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an Arrow list column without null values; a null list counts as empty."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return column.flatten().to_numpy(zero_copy_only=False), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct word n-gram hashes of each document, with new offsets.

    A document of fewer than n words, but at least one, has a single n-gram: all of it.
    """
    words = words.view(np.uint64) if words.dtype == np.int64 else words.astype(np.int64).view(np.uint64)
    lengths = np.diff(offsets)
    rest = np.repeat(offsets[1:], lengths) - np.arange(len(words))
    acc = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = np.concatenate((words[k:], np.zeros(min(k, len(words)), np.uint64)))
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + (part * (rest > k) if k else part) + np.uint64(k + 1))
    starts = rest >= n
    starts[offsets[:-1][lengths > 0]] = True
    ends = np.concatenate(([0], np.cumsum(starts)))[offsets]
    acc = acc[starts]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        acc[a:b].sort()
    fresh = np.ones(len(acc), bool)
    fresh[1:] = acc[1:] != acc[:-1]
    fresh[ends[:-1][np.diff(ends) > 0]] = True
    return acc[fresh], np.concatenate(([0], np.cumsum(fresh)))[ends]


def grouped(keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]):
    """Hand `work` tables of whole groups of a sorted partition, one after the other; a group may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            at = np.flatnonzero(new)
            joined = bool(held) and all(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() == c[0] for k, c in zip(keys, columns))
            last = int(at[-1]) + 1 if len(at) else 0
            if not last and (joined or not held):
                held.append(batch)
                continue
            done = [*held, batch.slice(0, last)] if last else held
            out = work(pa.Table.from_batches(done).combine_chunks())
            if out is not None:
                yield out
            held = [batch.slice(last)]
        if held:
            out = work(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield out

    return run
