"""The whole job: a file of any size in, a container out, and back. Run as `spark-submit chunkwise_job.py MODE INPUT OUTPUT`, or `python -m chunkwise`.

Tasks read byte ranges of the input and write parts beside the output; then the driver joins the parts into one object, portion by portion. The
checksum of the whole is put together from those of the chunks, so no one reads the input twice for it, and decompression compares both
checksum and length. Parts that a lost task left are written again under the same name; if the driver is lost while it joins them, finalize() alone does
that again. A scheduler can say what to do in the environment, see from_environment().
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import framing
from .functions.checksum import crc32_joined
from .functions.sizing import FLOOR, TARGET
from .operators import chunking, codec
from .operators.assembly import in_order
from .operators.metrics import Phases
from .sources import storage

#: Bytes of input of a task, at least; bytes that are copied at once when parts are joined.
PART, PORTION = 8 << 20, 32 << 20


#: What finalize() has to know, in the folder of the parts.
PLAN = "_plan"


class Failed(RuntimeError):
    """What came out isn't what went in."""


def chunk_size(total: int, pin: int | None = None) -> int:
    return pin or max(FLOOR, -(-total // max(4 * TARGET, 16)))


def _byte_parts(total: int, size: int) -> list[tuple[int, int, int]]:
    """(part, start, end): whole chunks, of PART bytes or more."""
    per = max(size, -(-PART // size) * size)
    return [(k, a, min(a + per, total)) for k, a in enumerate(range(0, total, per))]


def read_chunks(spark: SparkSession, url: str, pin: int | None = None) -> DataFrame:
    """(part, chunk_idx, byte_start, orig_len, data) of a file, read by ranges in the tasks. byte_start counts from the beginning of the file."""
    total = storage.size(url)
    size = chunk_size(total, pin)
    parts = _byte_parts(total, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(start, end, PORTION // size * size or size):
                    data, rows = storage.read_range(url, at, min(end, at + (PORTION // size * size or size))), []
                    for chunk in chunking.split_bytes(data, size):
                        rows.append((part, at, len(chunk), chunk))
                        at += len(chunk)
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["part", "byte_start", "orig_len", "data"])

    codec.small_batches(spark)
    ranges = spark.createDataFrame(parts, "part int, start long, end long").repartitionById(max(1, len(parts)), "part")
    # the place of a chunk is its first byte, which orders chunks as well as a number does
    return ranges.mapInArrow(run, "part int, byte_start long, orig_len int, data binary").withColumn("chunk_idx", F.lit(0)).select("part", "chunk_idx", "byte_start", "orig_len", "data")


def _written(parts: DataFrame, out: str, suffix: str = "") -> list[tuple]:
    """Write the column `body` of each part to its own object; (part, bytes, n, length, crc) of each, in order. Only these come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                storage.write(storage.part_name(out, part) + suffix, body.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.as_py()) for x in batch.column(1)], pa.int64()), *batch.columns[2:]], names=["part", "bytes", "n", "length", "crcs"])

    rows = parts.select("part", "body", "n", "length", "crcs").mapInArrow(run, "part int, bytes long, n long, length long, crcs binary").collect()
    return sorted(tuple(r) for r in rows)


def _crcs(crc: str, length: str) -> F.Column:
    """Checksums and lengths of a part's chunks, packed in order."""
    return F.expr(f"listagg(concat(unhex(lpad(hex({crc}), 8, '0')), unhex(lpad(hex({length}), 8, '0')))) within group (order by byte_start)")


def _whole_crc(rows: list[tuple]) -> int:
    crc = 0
    for r in rows:
        for at in range(0, len(r[4]), 8):
            crc = crc32_joined(crc, *framing.PAIR.unpack_from(r[4], at))
    return crc


def compress(spark: SparkSession, source: str, out: str, order: int = codec.ORDER, model: codec.Model | None = None, pin: int | None = None) -> dict:
    """Compress a file to a container at `out`, with the model at `out`.model. Returns what there is to say of the run."""
    began, phases = time.time(), Phases()
    chunks = read_chunks(spark, source, pin)
    with phases("fit"):
        model = model or codec.fit(chunks, order)
        codec.save_model(model, out + ".model")
    encoded = codec.encode(chunks, model, ["part"]).withColumn("entry", framing.entry(F.col("orig_len"), F.col("payload")))
    with phases("encode"):
        rows = _written(encoded.groupBy("part").agg(in_order("entry", "byte_start").alias("body"), F.count("*").alias("n"), F.sum("orig_len").alias("length"), _crcs("crc32", "orig_len").alias("crcs")), out)
    head = framing.Header(sum(r[3] for r in rows), sum(r[2] for r in rows), _whole_crc(rows), model.model_id)
    places, at = [], framing.LAYOUT.size
    for part, size, n, length, _ in rows:
        places.append((at, size, n, length))
        at += size
    with phases("finalize"):
        storage.write(out + ".index", json.dumps(places).encode())
        _plan_parts(out, head.pack(), rows)
        finalize(out)
    seconds = time.time() - began
    return {"mode": "compress", "orig": head.original_len, "comp": at, "n_chunks": head.n_chunks, "crc32": head.crc32, "ratio": at / head.original_len if head.original_len else 0.0, "seconds": seconds, "kb_s": head.original_len / 1024 / seconds, "phases": phases.seconds}


def _plan_parts(out: str, head: bytes, rows: list[tuple]) -> None:
    storage.write(f"{out}.parts/{PLAN}", json.dumps({"head": head.hex(), "parts": [[r[0], r[1]] for r in rows]}).encode())


def write_rows(rows: DataFrame, column: str, out: str) -> None:
    """The binary values of a sorted table, one behind the other, as one object. Tasks write parts; to the driver come their numbers and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sizes = TaskContext.get().partitionId(), [0]

        def values() -> Iterator[bytes]:
            for batch in batches:
                for value in batch.column(0):
                    raw = value.as_py() or b""
                    sizes.append(len(raw))
                    yield raw

        storage.write_parts(storage.part_name(out, part), values())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sum(sizes)], pa.int64())], names=["part", "bytes"])

    codec.small_batches(rows.sparkSession)
    _plan_parts(out, b"", sorted(tuple(r) for r in rows.select(column).mapInArrow(run, "part int, bytes long").collect()))
    finalize(out)


def finalize(out: str) -> None:
    """Join the parts of `out` behind their header, and delete them. Failed if a part isn't as large as it was when it was written."""
    plan = json.loads(storage.read_all(f"{out}.parts/{PLAN}"))
    parts = [part for part, _ in plan["parts"]]
    for part, size in plan["parts"]:
        if storage.size(storage.part_name(out, part)) != size:
            raise Failed(f"part {part} of {out} isn't whole")

    def portions() -> Iterator[bytes]:
        yield bytes.fromhex(plan["head"])
        for part in parts:
            name = storage.part_name(out, part)
            for at in range(0, storage.size(name), PORTION):
                yield storage.read_range(name, at, min(at + PORTION, storage.size(name)))

    storage.write_parts(out, portions())
    for part in parts:
        storage.delete(storage.part_name(out, part))
    storage.delete_folder(out + ".parts")


def read_container(spark: SparkSession, url: str) -> DataFrame:
    """(part, chunk_idx, byte_start, orig_len, crc32, payload) of a container; without its index it is one part."""
    head = framing.unpack_header(storage.read_range(url, 0, framing.LAYOUT.size))
    try:
        places = [tuple(p) for p in json.loads(storage.read_all(url + ".index"))]
    except FileNotFoundError:
        places = [(framing.LAYOUT.size, storage.size(url) - framing.LAYOUT.size, head.n_chunks, head.original_len)]
    rows, start = [], 0
    for k, (at, size, n, length) in enumerate(places):
        rows.append((k, at, size, n, start))
        start += length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, size, n, begin in zip(*(c.to_pylist() for c in batch.columns)):
                data = storage.read_range(url, at, at + size)
                if len(data) != size:
                    raise framing.Damaged("the container ends before its parts do")
                own = [(length, payload) for length, payload, _ in framing.entries(data, n, 0)]
                lengths, starts = [x for x, _ in own], []
                for x in lengths:
                    starts.append(begin)
                    begin += x
                for k in range(0, len(own), codec.LOCKSTEP):
                    some = slice(k, k + codec.LOCKSTEP)
                    m = len(own[some])
                    yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.array(starts[some], pa.int64()), pa.array(lengths[some], pa.int32()), pa.nulls(m, pa.int64()), pa.array([p for _, p in own[some]], pa.binary())], names=["part", "chunk_idx", "byte_start", "orig_len", "crc32", "payload"])

    codec.small_batches(spark)
    ranges = spark.createDataFrame(rows, "part int, at long, size long, n long, begin long").repartitionById(max(1, len(rows)), "part")
    return ranges.mapInArrow(run, "part int, chunk_idx int, byte_start long, orig_len int, crc32 long, payload binary")


def decompress(spark: SparkSession, source: str, out: str, model: codec.ChunkCodec | None = None) -> dict:
    """Restore the file that a container was made of. Failed, and nothing at `out`, if length or checksum aren't those in its header."""
    began, phases = time.time(), Phases()
    head = framing.unpack_header(storage.read_range(source, 0, framing.LAYOUT.size))
    model = model or codec.saved_model(source + ".model", head.model_id)
    if model.model_id != head.model_id:
        raise ValueError(f"the container is of model {head.model_id}, not {model.model_id}")
    chunks = codec.decode(read_container(spark, source), model, ["part"])
    if head.n_chunks:
        crc = F.crc32(F.coalesce("data", F.lit(b""))).alias("crc")
        parts = chunks.select("part", "byte_start", "data", F.octet_length("data").alias("size"), crc).groupBy("part").agg(in_order("data", "byte_start").alias("body"), F.count("data").alias("n"), F.sum("size").alias("length"), _crcs("crc", "coalesce(size, 0)").alias("crcs"))
        with phases("decode"):
            rows = _written(parts, out)
    else:
        rows = []
    length, crc = sum(r[3] or 0 for r in rows), _whole_crc(rows)
    if (length, sum(r[2] for r in rows)) != (head.original_len, head.n_chunks) or (not head.flags & framing.NO_CRC and crc != head.crc32):
        for r in rows:
            storage.delete(storage.part_name(out, r[0]))
        raise Failed(f"{length} bytes with checksum {crc:08x}, and there should be {head.original_len} with {head.crc32:08x}")
    with phases("finalize"):
        _plan_parts(out, b"", rows)
        finalize(out)
    seconds = time.time() - began
    return {"mode": "decompress", "orig": length, "n_chunks": head.n_chunks, "crc32": crc, "seconds": seconds, "kb_s": length / 1024 / seconds, "phases": phases.seconds}


def info(url: str) -> dict:
    """What a container's header says."""
    head = framing.unpack_header(storage.read_range(url, 0, framing.LAYOUT.size))
    return {"orig": head.original_len, "comp": storage.size(url), "n_chunks": head.n_chunks, "crc32": head.crc32, "model_id": head.model_id, "has_crc": not head.flags & framing.NO_CRC}


def verify(spark: SparkSession, source: str, work: str, most_ratio: float = 0.11, least_kb: float = 200.0, **options) -> dict:
    """Compress, restore, compare; the measured run with the gates that it has to pass."""
    from .operators import metrics

    up = compress(spark, source, work + ".chunkwise", **options)
    down = decompress(spark, work + ".chunkwise", work + ".restored")
    crc, size = 0, storage.size(work + ".restored")
    for at in range(0, size, PORTION):
        crc = zlib.crc32(storage.read_range(source, at, min(at + PORTION, size)), crc)
    run = spark.createDataFrame([(source, up["comp"], up["orig"], up["seconds"], down["seconds"], size == storage.size(source) and crc == down["crc32"])], "name string, comp long, orig long, encode_s double, decode_s double, exact boolean")
    return metrics.gates(run, most_ratio, least_kb).first().asDict()


def from_environment(spark: SparkSession, environment: Mapping[str, str]) -> dict:
    """Run what CHUNKWISE_MODE says: compress, decompress, verify or finalize; CHUNKWISE_INPUT and CHUNKWISE_OUTPUT are addresses, CHUNKWISE_CHUNK and CHUNKWISE_ORDER
    optional numbers. ValueError names what is missing."""
    mode = environment.get("CHUNKWISE_MODE", "")
    needed = {"finalize": ["OUTPUT"]}.get(mode, ["INPUT", "OUTPUT"])
    missing = [f"CHUNKWISE_{n}" for n in needed if not environment.get(f"CHUNKWISE_{n}")]
    if mode not in ("compress", "decompress", "verify", "finalize") or missing:
        raise ValueError(f"no {', '.join(missing)}" if missing else f"unknown mode {mode!r}")
    source, out = environment.get("CHUNKWISE_INPUT", ""), environment["CHUNKWISE_OUTPUT"]
    if mode == "finalize":
        finalize(out)
        return {"mode": mode}
    if mode == "decompress":
        return decompress(spark, source, out)
    chunk = environment.get("CHUNKWISE_CHUNK")
    run = compress if mode == "compress" else verify
    return run(spark, source, out, order=int(environment.get("CHUNKWISE_ORDER", codec.ORDER)), pin=int(chunk) if chunk else None)
