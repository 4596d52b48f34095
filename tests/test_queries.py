import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkwise.functions import sizing
from chunkwise.functions.cdf import TOTAL, cumulative, integer_cdf
from chunkwise.functions.coder import encode
from chunkwise.operators import assembly, chunking, codec, metrics
from chunkwise.plans import registry
from chunkwise.sources import blob
from chunkwise.streaming import encoder

from . import oracle


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    columns, rows = oracle.from_spark(registry.QUERIES[name](spark, oracle.SF))
    assert rows
    if name in registry.SQL:
        assert (columns, rows) == oracle.from_sql(registry.SQL[name])


@pytest.mark.parametrize("total,target,pin,size", [(0, 128, None, 65536), (-5, 128, None, 65536), (10_000, 128, None, 65536), (10 << 20, 128, None, 65536), (100 << 20, 128, None, 204800), (1 << 30, 128, None, 2 << 20), (1 << 30, 512, None, 524288), (1 << 30, 128, 131072, 131072), (None, 128, None, None)])
def test_chunk_sizes(spark, total, target, pin, size):
    assert spark.range(1).select(sizing.chunk_size(F.lit(total).cast("long"), target, pin)).first()[0] == size


@pytest.mark.parametrize("total,parts", [(100_000, 4), (0, 3), (65_536, 1), (10_000_000, 7), (517_000, 4)])
def test_parts_cover_everything_once(spark, total, parts):
    start, end = sizing.part_range(F.col("id"), F.lit(parts), F.lit(total))
    rows = sorted((r[0], r[1]) for r in spark.range(parts).select(start, end).collect())
    at = 0
    for a, b in rows:
        assert a <= b
        if a < b:
            assert a == at
            at = b
    assert at == total


def test_splitting_nulls_and_bad_bytes(spark):
    rows = [(1, None), (2, b""), (3, b"\x80" * 10), (4, "aé€😀".encode() * 5), (4, b"abc")]
    df = spark.createDataFrame(rows, "k long, raw binary").withColumn("data", F.lit("x"))
    got = chunking.split(df.drop("data"), ["k"], "raw", 4).collect()
    assert {r["k"] for r in got} == {3, 4}
    assert all(0 < r["orig_len"] <= 4 for r in got)
    by = {}
    for r in sorted(got, key=lambda r: (r["k"], r["chunk_idx"])):
        by.setdefault(r["k"], b"")
        by[r["k"]] += bytes(r["data"]) if r["k"] == 3 else b""
    assert by[3] == b"\x80" * 10
    assert chunking.split(df.limit(0), ["k"], "raw", 4).count() == 0


def test_codec_on_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "long " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("payload", F.lit(1))
    encoded, model = codec.compress(df, ["doc_id"], "text", pin=512)
    back = {r[0]: (bytes(r[1]).decode(), r[2]) for r in codec.decompress(encoded, model, ["doc_id"]).collect()}
    assert back == {3: ("x", True), 4: ("long " * 5000, True)}
    none, model = codec.compress(df.limit(0), ["doc_id"], "text")
    assert none.count() == 0 and model.model_id == codec.ORDER


def test_damaged_blobs_are_reported(spark):
    encoded, model = codec.compress(spark.createDataFrame([(1, "hello there"), (2, "again")], "doc_id long, text string"), ["doc_id"], "text", pin=4)
    whole = assembly.blobs(encoded, ["doc_id"], model.model_id)
    bad = whole.select("doc_id", F.expr("substring(blob, 1, length(blob) - 1)").alias("blob"))
    assert [r["error"] is not None for r in chunking.scan_entries(bad, "doc_id", "blob").collect()] == [True, True]
    mixed = bad.select("doc_id", F.lit(0).alias("part"), F.lit(b"nothing").alias("blob"))
    assert all(r["blob"] is None for r in assembly.master(mixed, ["doc_id"]).collect())


def test_integer_cdf_is_the_array_form(spark):
    counts = {"a": [5, 0, 7, 7], "b": [1, 1, 1, 1]}
    df = spark.createDataFrame([(c, s, n) for c, ns in counts.items() for s, n in enumerate(ns)], "ctx string, symbol int, n long")
    for c, ns in counts.items():
        rows = integer_cdf(df, ["ctx"]).where(F.col("ctx") == c).orderBy("symbol").collect()
        assert [r["lo"] for r in rows] + [TOTAL] == cumulative([ns])[0].tolist()


def test_gates(spark):
    runs = spark.createDataFrame([("a", 10, 1_000_000, 1.0, 2.0, True), ("b", 900_000, 1_000_000, 1.0, 1.0, True), ("c", 0, 0, 0.0, 0.0, True), ("d", 10, 1_000_000, 1.0, 1.0, False)], "name string, comp long, orig long, encode_s double, decode_s double, exact boolean")
    assert {r["name"]: r["passed"] for r in metrics.gates(runs).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_source_reads_ranges_and_sees_damage(spark, tmp_path):
    blob.register(spark)
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(40)], "doc_id long, text string")
    encoded, model = codec.compress(df, ["doc_id"], "text", pin=64)
    encoded.write.format("chunkwise").option("path", path).mode("append").save()
    (tmp_path / "t" / "part-left").write_bytes(b"of a task that failed")
    back = spark.read.format("chunkwise").option("path", path).option("bytes", 256).load()
    assert back.rdd.getNumPartitions() > 8 and back.dtypes[0] == ("doc_id", "bigint")
    assert {r[0]: bytes(r[1]).decode() for r in codec.decompress(back, model, ["doc_id"]).collect()} == dict((r[0], r[1]) for r in df.collect())
    part = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".index").with_suffix("")
    part.write_bytes(part.read_bytes()[:60])
    with pytest.raises(Exception, match="index|Damaged"):
        spark.read.format("chunkwise").option("path", path).load().count()


def test_source_takes_any_keys_appends_and_overwrites(spark, tmp_path):
    blob.register(spark)
    path = f"{tmp_path}/t"
    rows = [("a", 1, "one"), ("a", 2, "two, longer"), (None, 3, "three"), ("b", None, "four")]
    df = spark.createDataFrame(rows, "name string, turn int, text string")
    encoded, model = codec.compress(df, ["name", "turn"], "text", pin=4)
    for _ in range(2):
        encoded.write.format("chunkwise").option("path", path).option("bytes", 64).option("model_id", model.model_id).mode("append").save()
    back = spark.read.format("chunkwise").option("path", path).load()
    assert back.columns == encoded.columns and back.count() == 2 * encoded.count()
    encoded.where("name = 'a'").write.format("chunkwise").option("path", path).mode("overwrite").save()
    back = codec.decompress(spark.read.format("chunkwise").option("path", path).load(), model, ["name", "turn"])
    assert sorted((r[0], r[1], bytes(r[2]).decode(), r[3]) for r in back.collect()) == [("a", 1, "one", True), ("a", 2, "two, longer", True)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("_committed")]) == 1
    codec.save_model(model, f"{path}/model")
    assert codec.saved_model(f"{path}/model", model.model_id).bounds.tolist() == model.bounds.tolist()
    with pytest.raises(ValueError, match="holds model"):
        codec.saved_model(f"{path}/model", model.model_id + 1)


def test_codec_with_a_model_that_is_a_function(spark):
    def step(state, last):
        counts = np.ones(256) if state is None else state
        counts = counts.copy()
        counts[last] += 20
        return counts / counts.sum(), counts

    model = codec.StepModel(step, 77)
    df = spark.createDataFrame([(1, "abracadabra " * 30), (2, "é")], "k long, text string")
    encoded, _ = codec.compress(df, ["k"], "text", model, pin=100)
    assert encoded.agg(F.sum("comp_len") * 1.0 / F.sum("orig_len")).first()[0] < 0.7
    assert {r[0]: (bytes(r[1]).decode(), r[2]) for r in codec.decompress(encoded, model, ["k"]).collect()} == {1: ("abracadabra " * 30, True), 2: ("é", True)}
    pairs = codec.StepModel(lambda state, last: (np.full(1 << 16, 1 / 65536), None), 78, 0, lambda raw: [a << 8 | b for a, b in zip(raw[::2], raw[1::2])], lambda s: b"".join(bytes([x >> 8, x & 255]) for x in s))
    assert pairs.restore(pairs.compress([b"even", b""])) == [b"even", b""]


def test_codec_of_functions(spark):
    import zlib

    df = spark.createDataFrame([(1, "abc " * 300), (2, "é")], "k long, text string")
    for model in (codec.FunctionCodec(5, zlib.compress, zlib.decompress), codec.FunctionCodec(6, each_of=lambda x: [zlib.compress(c) for c in x], back_of=lambda x: [zlib.decompress(c) for c in x])):
        encoded, _ = codec.compress(df, ["k"], "text", model, pin=100)
        assert {r[0]: (bytes(r[1]).decode(), r[2]) for r in codec.decompress(encoded, model, ["k"]).collect()} == {1: ("abc " * 300, True), 2: ("é", True)}


def test_incremental_stream_gives_the_bits_of_one_go(spark, tmp_path):
    counts, symbols = [8, 1, 3, 2], [int(x) for x in (0, 1, 2, 3, 0, 0, 2, 1) * 20]
    rows = [(k, i, s) for k in (1, 2) for i, s in enumerate(symbols[: 100 + 30 * k])]
    batches = [[r for r in rows if r[1] < 50], [r for r in rows if r[1] >= 50], [(1, 1000, -1), (2, 1000, -1)]]
    for b in batches:
        spark.createDataFrame(b, "key long, position long, symbol int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("key long, position long, symbol int").parquet(f"{tmp_path}/in")
        out = encoder.incremental(source, counts)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r["n_symbols"], r["closed"])):
        got[r["key"]] = got.get(r["key"], b"") + bytes(r["bits"])
    bounds = cumulative([counts])[0]
    assert got == {k: encode(bounds, symbols[: 100 + 30 * k]) for k in (1, 2)}


def test_windowed_sizes(spark, tmp_path):
    spark.read.parquet(f"{oracle.SF}/events.parquet").select("ts", F.length("props").alias("size")).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp, size int").parquet(f"{tmp_path}/in")
    q = encoder.windowed_sizes(source, "ts", "size").writeStream.format("memory").queryName("sizes").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sizes").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{tmp_path}/in").count()


def test_chunks_of_a_query_are_encoded_once(spark):
    """Neither the checksums of intact and damaged chunks nor the master blobs ask for their chunks twice."""
    for name, maps in (("crc_check", 2), ("assemble_master", 2)):  # to encode, and to decode or scan
        plan = registry.QUERIES[name](spark, oracle.SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == maps


def test_writer_takes_batches_across_which_blobs_go(tmp_path):
    """Batches of Arrow, not rows; blobs end within a batch and go on over several."""
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(f"{blob.KEYS}, {blob.CHUNKS}")
    names = schema.fieldNames()
    rows = [(k, 0, 0, 5, 10 + k, k, bytes([k]) * (10 + k)) for k in range(90)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some) if some else [()] * 7, kinds)], names=names) for some in (rows[:3], [], rows[3:50], rows[50:])]
    for size in (64, 700, 1 << 20):
        path = f"{tmp_path}/{size}"
        writer = blob._Writer(path, schema, 7, size, False)
        writer.commit([writer.write(iter(batches))])
        reader = blob._Reader(path, schema, 500)
        got = sorted(tuple(r[c] for c in names) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist())
        assert got == rows and blob.described(path)["model_id"] == 7


def test_rows_of_chunks_do_not_carry_their_texts(spark):
    df = spark.createDataFrame([(1, "x" * 5000)], "k long, text string")
    plan = chunking.split(df, ["k"], "text", 16)._jdf.queryExecution().optimizedPlan()
    generate = next(line for line in plan.toString().split("\n") if "Generate" in line)
    assert "__raw" not in generate.split("), [")[1].split("]")[0] and plan.toString().split("Generate")[0].count("__raw") == 0
