"""The container as a data source: `spark.read.format("chunkwise")` gives chunks, writing one takes encoded chunks.

A table is a folder with blobs of bounded size, or a single blob. The columns before chunk_idx are the keys, of any number and
type. Beside each blob is an index of its chunks, an Arrow file, which is read by the task that reads the blob: the driver only learns how many
chunks and bytes a blob has. A reader fetches the bytes of its chunks and no others; a blob without an index is scanned. Nothing that a failed
task left is read: a blob counts only if a commit names it, and each write has its own commit, so that writers don't undo one another.
The folder has to be one that all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import framing
from . import storage

KEYS = "doc_id long"
CHUNKS = "chunk_idx int, byte_start long, orig_len int, comp_len int, crc32 long, payload binary"
COMMITTED = "_committed"
#: Bytes of payload of a partition that is read; bytes after which a writer begins another blob.
PARTITION, BLOB = 16 << 20, 64 << 20


@dataclass
class _Part(InputPartition):
    """Chunks first to last of a blob; all of one without an index."""

    blob: str
    first: int
    last: int
    indexed: bool


@dataclass
class _Written(WriterCommitMessage):
    blobs: list


def _commits(path: str) -> list[str]:
    return [p for p, _ in storage.listed(path) if p.rpartition("/")[2].startswith(COMMITTED)]


def described(path: str) -> dict:
    """What the commits of a table say: its blobs (name, chunks, bytes), the DDL of its keys, its model's id."""
    out: dict = {"blobs": [], "keys": KEYS, "model_id": 0}
    for commit in _commits(path):
        own = json.loads(storage.read_all(commit))
        out = {**out, **own, "blobs": out["blobs"] + own["blobs"]}
    return out


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, size: int):
        self.path, self.schema, self.size = path.rstrip("/"), schema, size

    def partitions(self) -> list[_Part]:
        commits = _commits(self.path)
        if not commits:
            return [_Part(p, 0, 0, False) for p, _ in storage.listed(self.path) if not p.endswith(".index")] or [_Part("", 0, 0, False)]
        out = []
        for name, chunks, size in described(self.path)["blobs"]:
            parts = max(1, min(chunks, -(-size // self.size)))
            out += [_Part(f"{self.path}/{name}", k * chunks // parts, (k + 1) * chunks // parts, True) for k in range(parts)]
        return out or [_Part("", 0, 0, False)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.blob:
            return
        if part.indexed:
            rows = pa.ipc.open_file(pa.BufferReader(storage.read_all(part.blob + ".index"))).read_all().slice(part.first, part.last - part.first)
        else:
            rows = self._scanned(part.blob)
        places, sizes, lengths = (rows.column(c).to_pylist() for c in ("place", "comp_len", "orig_len"))
        if not places:
            return
        start = places[0]
        whole = storage.read_range(part.blob, start, places[-1] + framing.PAIR.size + sizes[-1])
        payloads = [whole[p - start + framing.PAIR.size : p - start + framing.PAIR.size + n] for p, n in zip(places, sizes)]
        for p, n, length, payload in zip(places, sizes, lengths, payloads):
            if len(payload) != n or framing.PAIR.unpack_from(whole, p - start) != (length, n):
                raise framing.Damaged(f"{part.blob} doesn't agree with its index at {p}")
        kinds = to_arrow_schema(self.schema)
        columns = [pa.array(payloads, pa.binary()) if f.name == "payload" else rows.column(f.name).combine_chunks().cast(f.type) if f.name in rows.column_names else pa.nulls(len(payloads), f.type) for f in kinds]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    @staticmethod
    def _scanned(blob: str) -> pa.Table:
        data = storage.read_all(blob)
        rows, at = [], 0
        for i, (n, payload, place) in enumerate(framing.entries(data, framing.unpack_header(data).n_chunks)):
            rows.append({"chunk_idx": i, "byte_start": at, "orig_len": n, "comp_len": len(payload), "place": place})
            at += n
        return pa.Table.from_pylist(rows, pa.schema([("chunk_idx", pa.int32()), ("byte_start", pa.int64()), ("orig_len", pa.int32()), ("comp_len", pa.int32()), ("place", pa.int64())]))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, model_id: int, size: int, overwrite: bool):
        self.path, self.schema, self.model_id, self.size, self.overwrite = path.rstrip("/"), schema, model_id, size, overwrite
        names = schema.fieldNames()
        if names[-6:] != [c.split()[0] for c in CHUNKS.split(", ")]:
            raise ValueError(f"the columns have to be keys and then {CHUNKS}")
        self.keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-6])

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        kinds = to_arrow_schema(StructType(self.schema.fields[:-1])).append(pa.field("place", pa.int64()))
        done, body, index, at = [], [], [], framing.LAYOUT.size

        def flush() -> None:
            name, rows = f"part-{uuid.uuid4().hex}", pa.Table.from_batches(index)
            head = framing.Header(sum(rows.column("orig_len").to_pylist()), len(rows), 0, self.model_id, framing.NO_CRC).pack()
            storage.write_parts(f"{self.path}/{name}", [head, *body])
            out = pa.BufferOutputStream()
            with pa.ipc.new_file(out, kinds) as to:
                to.write_table(rows)
            storage.write(f"{self.path}/{name}.index", out.getvalue().to_pybytes())
            done.append((name, len(rows), at))

        for batch in batches:
            payloads, lengths = batch.column("payload"), batch.column("orig_len").to_pylist()
            fields = {f.name: batch.column(i).cast(f.type) for i, f in enumerate(list(kinds)[:-1])}
            first, places, sizes = 0, [], []
            for i, (n, payload) in enumerate(zip(lengths, payloads)):
                payload = payload.as_py()
                places.append(at), sizes.append(len(payload))
                body.append(framing.PAIR.pack(n, len(payload)) + payload)
                at += len(body[-1])
                if at >= self.size or i + 1 == len(lengths):
                    own = {c: x.slice(first, len(places)) for c, x in fields.items()} | {"comp_len": pa.array(sizes, kinds.field("comp_len").type), "place": pa.array(places, pa.int64())}
                    index.append(pa.RecordBatch.from_arrays([own[f.name] for f in kinds], schema=kinds))
                    first, places, sizes = i + 1, [], []
                if at >= self.size:
                    flush()
                    body, index, at = [], [], framing.LAYOUT.size
        if index:
            flush()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        try:
            before = [p for p, _ in storage.listed(self.path)] if self.overwrite else []
        except FileNotFoundError:
            before = []
        blobs = sorted(b for m in messages if m for b in m.blobs)
        storage.write(f"{self.path}/{COMMITTED}-{uuid.uuid4().hex}", json.dumps({"blobs": blobs, "keys": self.keys, "model_id": self.model_id}).encode())
        own = {name for name, _, _ in blobs}
        # commits go first: what they name is then no longer part of the table
        for p in sorted(before, key=lambda p: COMMITTED not in p):
            if p.rpartition("/")[2].removesuffix(".index") not in own:
                storage.delete(p)

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for name, _, _ in m.blobs if m else ():
                storage.delete(f"{self.path}/{name}")
                storage.delete(f"{self.path}/{name}.index")


class ChunkwiseSource(DataSource):
    """Options: path; bytes (of a read partition, or of a blob that is written); model_id (on writing)."""

    @classmethod
    def name(cls) -> str:
        return "chunkwise"

    def schema(self) -> str:
        try:
            keys = described(self.options["path"])["keys"]
        except FileNotFoundError:
            keys = KEYS
        return f"{keys}, {CHUNKS}" if keys else CHUNKS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("bytes", PARTITION)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, int(self.options.get("model_id", 0)), int(self.options.get("bytes", BLOB)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkwiseSource)
