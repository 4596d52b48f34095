"""Queries over the test tables that exercise every operator of the engine, each over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import job
from ..functions import framing, sizing, tokens
from ..functions.cdf import TOTAL, integer_cdf
from ..operators import assembly, chunking, codec, metrics, offsets, sequence
from ..sources import blob, storage
from ..sources.shared import new_folder, spread
from ..streaming import encoder

#: A public vocabulary of byte pairs, as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Chunk size of the queries; at the default one, a text of this corpus would be one chunk.
PIN = 1024
#: A small fixed matrix, so that products have an oracle.
WEIGHTS = [[((k * 7 + n * 13) % 11 - 5) / 10 for k in range(64)] for n in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def chunk_size_by_total(spark, d):
    total = F.floor(F.col("o_totalprice") * 10000).cast("long")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", total.alias("total"), sizing.chunk_size(total).alias("chunk_size"), sizing.chunk_size(total, target=512).alias("chunk_size_512"), sizing.chunk_size(total, pin=131072).alias("chunk_size_pinned"))


def _totals(spark, d):
    return table(spark, d, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg(F.sum(F.floor(F.col("o_totalprice")).cast("long")).alias("total"))


def part_byte_ranges(spark, d):
    rows = _totals(spark, d).select("o_orderpriority", "total", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("part"))
    start, end = sizing.part_range(F.col("part"), F.lit(7), F.col("total"))
    return rows.select("o_orderpriority", "part", start.alias("byte_start"), end.alias("byte_end")).where("byte_start < byte_end")


def chunk_index_ranges(spark, d):
    chunks = table(spark, d, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n_chunks"))
    rows = chunks.select("c_nationkey", "n_chunks", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("part"))
    start, end = sizing.index_range(F.col("part"), F.lit(7), F.col("n_chunks"))
    return rows.select("c_nationkey", "part", start.alias("first_chunk"), end.alias("end_chunk")).where("first_chunk < end_chunk")


def chunk_catalog(spark, d):
    chunks = chunking.split(table(spark, d, "documents", "doc_id", "text"), ["doc_id"], "text", PIN)
    return chunks.select("doc_id", "chunk_idx", "byte_start", "orig_len", F.md5("data").alias("md5"))


def chunk_catalog_arrow(spark, d):
    chunks = chunking.split_arrow(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", PIN)
    return chunks.select("doc_id", "chunk_idx", "byte_start", "orig_len", F.md5("data").alias("md5"))


def chunk_summary_by_lang(spark, d):
    chunks = chunking.split(table(spark, d, "documents", "doc_id", "lang", "text"), ["doc_id", "lang"], "text", PIN)
    return chunks.groupBy("lang", "doc_id").agg(F.count("*").alias("n"), F.sum("orig_len").alias("bytes")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_chunks"), F.sum("bytes").cast("long").alias("total_bytes"))


def bitstream_offsets(spark, d):
    room = F.octet_length("text").cast("long") + sizing.SLACK
    rows = table(spark, d, "documents", "doc_id", "lang", "text").select("lang", "doc_id", room.alias("room"))
    return offsets.running_total(rows, ["lang"], "doc_id", "room", "bit_offset").select("lang", "doc_id", "room", "bit_offset")


def token_frequency(spark, d):
    return tokens.symbol_counts(spread(table(spark, d, "documents", "lang", "text")), ["lang"], "text")


def bos_shift(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(tokens.code_points(F.col("text"))).alias("pos", "token"))
    return tokens.bos_shift(rows, ["item_id"], "pos", "token")


def bigram_counts(spark, d):
    return tokens.symbol_counts(spread(table(spark, d, "documents", "lang", "text")), ["lang"], "text", pairs=True)


def token_windows(spark, d):
    """Windows of 256 tokens, with the padding that the last one of a text takes."""
    n = F.size(tokens.characters(F.col("text")))
    rows = table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", n.alias("n")).where("n > 0")
    rows = rows.select("conv_id", "turn", "n", F.explode(F.sequence(F.lit(0), tokens.windows(F.col("n") - 1, 256)[0])).alias("win"))
    used = F.least(F.lit(256), F.col("n") - F.col("win") * 256)
    return rows.select("conv_id", "turn", "win", used.alias("used"), (256 - used).alias("padding"))


def cdf_by_lang(spark, d):
    return integer_cdf(token_frequency(spark, d), ["lang"])


def cdf_invariants(spark, d):
    rows = cdf_by_lang(spark, d)
    return rows.groupBy("lang").agg(F.count("*").alias("n_symbols"), F.min("lo").alias("first_lo"), F.max(F.col("lo") + F.col("width")).alias("last_hi"), F.min("width").alias("min_width"), F.sum("width").cast("long").alias("total_width"))


def ideal_bits_by_doc(spark, d):
    counts = tokens.symbol_counts(spread(table(spark, d, "documents", "doc_id", "lang", "text")), ["doc_id", "lang"], "text")
    bits = metrics.ideal_bits(counts, cdf_by_lang(spark, d), ["doc_id"], ["lang", "symbol"])
    return bits.select("doc_id", F.round("bits", 3).alias("bits"))


def _embeddings(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding")


def _spread(rows, name):
    return rows.select("vec_id", F.posexplode(name).alias("pos", "v")).select("vec_id", "pos", F.round("v", 8).alias(name))


def softmax_rows(spark, d):
    return _spread(_embeddings(spark, d).select("vec_id", sequence.softmax(F.col("embedding"), 1e-9).alias("p")), "p")


def layer_norm_rows(spark, d):
    return _spread(_embeddings(spark, d).select("vec_id", sequence.layer_norm(F.col("embedding")).alias("y")), "y")


def probability_cdf(spark, d):
    """Distributions that come as probabilities: counts of 2 ** -30, then whole widths."""
    p = sequence.softmax(F.col("embedding"))
    rows = _embeddings(spark, d).select("vec_id", F.posexplode(F.transform(p, lambda v: F.floor(F.round(v, 9) * (1 << 30)).cast("long"))).alias("symbol", "n"))
    return integer_cdf(rows, ["vec_id"])


def premix_lag(spark, d):
    events = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    mixed = sequence.premix(events, ["user_id"], ["ts", "event_id"], "value", {"kx": 0.3, "vx": 0.5, "rx": 0.8})
    return mixed.select("event_id", *(F.round(c, 6).alias(c) for c in ("kx", "vx", "rx")))


def relu_sq_sigmoid(spark, d):
    x = F.col("value") / 50 - 1
    return table(spark, d, "events", "event_id", "value").select("event_id", F.round(sequence.relu_squared(x), 8).alias("relu_sq"), F.round(sequence.sigmoid(x), 8).alias("sigmoid"))


def wkv_scan(spark, d):
    events = table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("k", F.col("value") / 100)
    return sequence.wkv_scan(events, "user_id", ["ts", "event_id"], "k", "value").withColumn("y", F.round("y", 6))


def wkv_rows(spark, d):
    """The recurrence within each vector, without Python."""
    y = sequence.wkv_fold(F.col("embedding"), F.col("embedding"))
    return _spread(_embeddings(spark, d).select("vec_id", y.alias("y")), "y")


def layer_step(spark, d):
    events = table(spark, d, "events", "event_id", "user_id", "ts", "value").withColumn("x", F.col("value") / 100)
    return sequence.layer_step(events, "user_id", ["ts", "event_id"], "x").withColumn("y", F.round("y", 6))


def matvec(spark, d):
    rows = _embeddings(spark, d).select("vec_id", F.posexplode(sequence.matvec(F.col("embedding"), WEIGHTS)).alias("n", "y"))
    return rows.select("vec_id", "n", F.round("y", 8).alias("y"))


def matvec_kvr(spark, d):
    k, v, r = sequence.matvec3(F.col("embedding"), WEIGHTS[:2], WEIGHTS[2:4], WEIGHTS[4:6])
    return _embeddings(spark, d).select("vec_id", *(F.round(m[i], 8).alias(f"{name}{i}") for name, m in (("k", k), ("v", v), ("r", r)) for i in (0, 1)))


def matmul_join(spark, d):
    left = table(spark, d, "lineitem", "l_suppkey", "l_linenumber", "l_quantity").groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("long").alias("k")).agg(F.sum("l_quantity").alias("x"))
    right = spark.range(1, 8).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).withColumn("w", F.col("k") * 2 - F.col("j"))
    return sequence.matmul_join(left, right)


def quantized_matvec(spark, d):
    """Products with numbers of eight bits, and how far they are off."""
    both = _embeddings(spark, d).select("vec_id", sequence.matvec(F.col("embedding"), WEIGHTS).alias("exact"), sequence.matvec(sequence.quantize(F.col("embedding"))["dequantized"], WEIGHTS).alias("y"))
    rows = both.select("vec_id", F.posexplode(F.arrays_zip("exact", "y")).alias("n", "p"))
    return rows.select("vec_id", "n", F.round("p.y", 6).alias("y"), (F.abs(F.col("p.y") - F.col("p.exact")) < 0.05).alias("near"))


def quantized_weights(spark, d):
    """Products with a matrix whose weights are numbers of eight bits, scaled by input channel."""
    y = sequence.matvec(F.col("embedding"), sequence.quantized_weights(WEIGHTS))
    return _embeddings(spark, d).select("vec_id", F.posexplode(y).alias("n", "y")).select("vec_id", "n", F.round("y", 6).alias("y"))


def layer_rows(spark, d):
    """A layer of several channels over the events of each user: norms, products, recurrence and gates."""
    x = F.array(*((F.col("value") / 100 * (k + 1) + F.pmod("event_id", F.lit(k + 2)) - 1).cast("double") for k in range(4)))
    events = table(spark, d, "events", "event_id", "user_id", "ts", "value").where("value is not null").withColumn("x", x)
    out = sequence.layer(events, "user_id", ["ts", "event_id"], "x", sequence.Layer.of(4))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.max("position").alias("last"), F.bool_and(F.forall("y", lambda v: ~F.isnan(v) & (F.abs(v) < 1e6))).alias("finite"))


def size_ratios(spark, d):
    """Ratios and bits per byte of sums over groups, on columns whose sums are known."""
    small, large = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    rows = table(spark, d, "lineitem", "l_returnflag", "l_linenumber", "l_quantity").groupBy("l_returnflag")
    return rows.agg(F.round(metrics.ratio(small, large), 9).alias("ratio"), F.round(metrics.bits_per_byte(small, large), 9).alias("bits_per_byte"))


def windowed_stream(spark, d):
    """Tumbling windows of a day over a stream of events."""
    events = table(spark, d, "events")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    path = new_folder(spark, "windows")
    # times without a zone are read as UTC, whatever the session's zone
    utc = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    sizes = encoder.windowed_sizes(source.select(utc.alias("ts"), F.length("props").alias("size")), "ts", "size")
    name = path.rpartition("/")[2].replace("-", "_")
    sizes.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window_start") / 86400).cast("int"))
    return spark.table(name).select(day.alias("day"), "n", F.col("total").cast("long").alias("total"))


def uint8_quantize(spark, d):
    q = sequence.quantize(F.col("embedding"))
    total = F.aggregate(q["q"], F.lit(0), lambda a, v: a + v)
    return _embeddings(spark, d).select("vec_id", F.round(q["scale"], 10).alias("scale"), F.round(q["offset"], 8).alias("offset"), F.round(q["rel_rmse"], 6).alias("rel_rmse"), total.cast("long").alias("q_sum"))


def quantization_sweep(spark, d):
    """How far numbers move when they are rounded to finer and finer grids."""
    events = table(spark, d, "events", "event_id", "value").where("value is not null")
    errors = [F.max(F.abs(sequence.snapped(F.col("value"), s) - F.col("value"))).alias(f"s{s}") for s in (1, 4, 16, 64)]
    row = events.agg(*errors)
    return row.select(F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), F.round(f"s{s}", 8).alias("max_error")) for s in (1, 4, 16, 64)))).alias("r")).select("r.*")


def topk_hit_rate(spark, d):
    rows = table(spark, d, "embeddings", "embedding", "label").select(sequence.rank_of(F.col("embedding"), F.col("label")).alias("rank"))
    return sequence.hit_rates(rows, "rank").select("k", F.round("hit_rate", 9).alias("hit_rate"))


def embedding_lookup(spark, d):
    events = table(spark, d, "events", "event_id", "user_id")
    vectors = sequence.lookup(events, _embeddings(spark, d), "user_id", "vec_id").select("event_id", "vec_id", F.posexplode_outer("embedding").alias("pos", "v"))
    return vectors.select("event_id", "vec_id", "pos", F.round(F.col("v").cast("double"), 8).alias("v"))


def _packed(spark, d, name, keys, text, order=1):
    return codec.compress(spread(table(spark, d, name, *keys, text)), keys, text, pin=PIN, order=order)


def codec_roundtrip_docs(spark, d):
    encoded, model = _packed(spark, d, "documents", ["doc_id"], "text")
    return codec.decompress(encoded, model, ["doc_id"]).select("doc_id", F.decode("data", "UTF-8").alias("text"), "crc_ok")


def codec_roundtrip_conversations(spark, d):
    encoded, model = _packed(spark, d, "conversations", ["conv_id", "turn"], "text", order=2)
    return codec.decompress(encoded, model, ["conv_id", "turn"]).select("conv_id", "turn", F.decode("data", "UTF-8").alias("text"), "crc_ok")


def codec_roundtrip_pages(spark, d):
    encoded, model = _packed(spark, d, "pages", ["page_id"], "html", order=0)
    return codec.decompress(encoded, model, ["page_id"]).select("page_id", F.decode("data", "UTF-8").alias("html"), "crc_ok")


def datasource_roundtrip(spark, d):
    """Encoded, written as blobs by the data source, read back by ranges of chunks, decoded."""
    blob.register(spark)
    encoded, model = _packed(spark, d, "documents", ["doc_id"], "text")
    path = new_folder(spark, "blobs")
    encoded.write.format("chunkwise").option("path", path).option("model_id", model.model_id).mode("append").save()
    back = codec.decompress(spark.read.format("chunkwise").option("path", path).load(), model, ["doc_id"])
    return back.select("doc_id", F.decode("data", "UTF-8").alias("text"), "crc_ok")


def datasource_of_turns(spark, d):
    """As above, of conversations: two keys, and a model that is read back from beside the blobs."""
    blob.register(spark)
    encoded, model = _packed(spark, d, "conversations", ["conv_id", "turn"], "text")
    path = new_folder(spark, "blobs")
    encoded.write.format("chunkwise").option("path", path).option("model_id", model.model_id).mode("append").save()
    codec.save_model(model, f"{path}.model")
    saved = codec.saved_model(f"{path}.model", blob.described(path)["model_id"])
    back = codec.decompress(spark.read.format("chunkwise").option("path", path).load(), saved, ["conv_id", "turn"])
    return back.select("conv_id", "turn", F.decode("data", "UTF-8").alias("text"), "crc_ok")


def job_roundtrip(spark, d):
    """The texts of each language as a file, compressed to a container and restored by the job."""
    folder, rows = new_folder(spark, "job"), []
    docs = table(spark, d, "documents", "doc_id", "lang", "text").where("text is not null")
    for (lang,) in docs.select("lang").where("lang is not null").distinct().orderBy("lang").collect():
        source = f"{folder}/{lang}"
        lines = docs.where(F.col("lang") == lang).orderBy(F.asc_nulls_last("doc_id"))
        job.write_rows(lines.select(F.concat(F.col("text").cast("binary"), F.lit(b"\n")).alias("raw")), "raw", source)
        up = job.compress(spark, source, f"{source}.out", order=1, pin=4 * PIN)
        down = job.decompress(spark, f"{source}.out", f"{source}.back")
        rows.append((lang, up["orig"], down["orig"], up["crc32"] == down["crc32"], 0 < up["comp"] < up["orig"], f"{source}.back"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [storage.md5(url) for url in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.string())], names=[*batch.schema.names[:5], "md5"])

    # a file may be too large for a value, so tasks read it in portions
    kinds = "lang string, orig long, restored long, same_crc boolean, smaller boolean"
    done = spark.createDataFrame(rows, f"{kinds}, url string").repartition(max(1, len(rows)), "lang")
    return done.mapInArrow(run, f"{kinds}, md5 string")


def bpe_roundtrip(spark, d):
    """Texts as tokens of byte pairs, and back."""
    docs = spread(table(spark, d, "documents", "doc_id", "text").where("text is not null"))
    ids = docs.select("doc_id", tokens.bpe_encode(VOCABULARY)("text").alias("ids"))
    return ids.select("doc_id", tokens.bpe_decode(VOCABULARY)("ids").alias("text"), (F.size("ids") > 0).alias("some"))


def bpe_batches(spark, d):
    """Sequences of benchmark items padded to the longest of their batch, and how many are decoded together."""
    rows = table(spark, d, "benchmark").select("item_id", tokens.code_points(F.col("text")).alias("ids")).withColumn("batch", F.pmod("item_id", F.lit(8)))
    longest = F.max(F.size("ids")).over(Window.partitionBy("batch"))
    padded = rows.withColumn("ids", tokens.padded(F.col("ids"), longest))
    n = F.count("*").over(Window.partitionBy("batch"))
    return padded.select("item_id", F.size("ids").alias("n"), F.array_max("ids").alias("top"), sizing.decode_batches(n, cores=2, per_core=2).cast("long").alias("together"))


def stream_roundtrip(spark, d):
    """The documents as a stream, encoded batch by batch, then decoded."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    model = codec.fit(chunking.split(docs, ["doc_id"], "text", PIN), 1)
    codec.small_batches(spark)
    path = new_folder(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/documents.parquet").schema).parquet(f"{d}/documents.parquet*")
    out = encoder.encode_stream(source, ["doc_id"], "text", model, PIN)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}.state").trigger(availableNow=True).start().awaitTermination()
    return codec.decompress(spark.read.parquet(path), model, ["doc_id"]).select("doc_id", F.decode("data", "UTF-8").alias("text"), "crc_ok")


def coder_near_ideal(spark, d):
    """Coded bits of each language against its cross-entropy under the same model: never fewer, and hardly more."""
    docs = spread(table(spark, d, "documents", "doc_id", "lang", "text"))
    chunks = chunking.split(docs, ["doc_id", "lang"], "text", PIN)
    model = codec.fit(chunks, 0)
    codec.small_batches(spark)
    bounds = model.bounds[0]
    widths = spark.createDataFrame([(s, int(bounds[s + 1] - bounds[s])) for s in range(256)], "symbol int, width long")
    coded = codec.encode(chunks, model, ["doc_id", "lang"]).groupBy("lang").agg(F.sum((F.col("comp_len") - 8) * 8).alias("coded"), F.count("*").alias("n"))
    counts = codec.count_model(chunks.select("data"), 0)
    per = tokens.symbol_counts(chunks.select("lang", "data"), ["lang"], "data")
    ideal = metrics.ideal_bits(per, widths, ["lang"], ["symbol"])
    total = counts.agg(F.sum("n").alias("bytes"))
    return coded.join(ideal, "lang").crossJoin(total).select("lang", (F.col("coded") >= F.floor("bits")).alias("not_below"), (F.col("coded") <= F.col("bits") + 16 * F.col("n")).alias("near"), (F.col("bytes") > 0).alias("counted"))


def header_fields(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("raw")).where("raw is not null")
    n = sizing.quotient(F.octet_length("raw") + (PIN - 1), F.lit(PIN))
    heads = docs.select("doc_id", framing.header(F.octet_length("raw"), n, F.crc32("raw")).alias("head"), F.crc32("raw").alias("crc"))
    fields = [framing.header_field(F.col("head"), f).cast("long").alias(f) for f in ("blob_version", "adapter_id", "flags", "original_len", "n_chunks")]
    return heads.select("doc_id", F.octet_length("head").alias("header_len"), framing.header_field(F.col("head"), "magic").alias("magic"), *fields, (framing.header_field(F.col("head"), "crc32") == F.col("crc")).alias("crc_same"))


def assemble_master(spark, d):
    """Each document's chunks dealt out to two parts, each part a blob, and one blob from both; scanned again."""
    encoded, model = _packed(spark, d, "documents", ["doc_id"], "text", order=0)
    encoded = encoded.withColumn("part", F.when(F.col("chunk_idx") < 2, 0).otherwise(1))
    parts = assembly.blobs(encoded, ["doc_id", "part"], model.model_id)
    whole = assembly.master(parts, ["doc_id"])
    # fields of headers go through the scan with their blobs, which are put together once
    fields = {name: framing.header_field(F.col("blob"), name) for name in ("n_chunks", "flags")} | {"original_len": framing.header_field(F.col("blob"), "original_len").cast("long")}
    scanned = chunking.scan_entries(whole.select("doc_id", "blob", *(c.alias(name) for name, c in fields.items())), "doc_id", "blob", *fields).groupBy("doc_id", *fields)
    counts = scanned.agg(F.count("chunk_idx").alias("scanned"), F.sum("orig_len").cast("long").alias("scanned_len"), F.count("error").alias("errors"))
    return counts.select("doc_id", "n_chunks", "original_len", "flags", "scanned", "scanned_len", "errors")


def ratio_by_lang(spark, d):
    encoded, _ = codec.compress(spread(table(spark, d, "documents", "doc_id", "lang", "text")), ["doc_id", "lang"], "text", pin=4096)
    return encoded.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.sum("orig_len").alias("orig"), F.sum("comp_len").alias("comp"), metrics.ratio(F.col("comp_len"), F.col("orig_len")).alias("ratio"), metrics.bits_per_byte(F.col("comp_len"), F.col("orig_len")).alias("bits_per_byte"))


def ratio_rollup(spark, d):
    encoded, _ = codec.compress(spread(table(spark, d, "documents", "doc_id", "lang", "source", "text")), ["doc_id", "lang", "source"], "text", pin=4096)
    return encoded.rollup("lang", "source").agg(F.sum("orig_len").alias("orig"), F.sum("comp_len").alias("comp"), metrics.ratio(F.col("comp_len"), F.col("orig_len")).alias("ratio"))


def ratio_by_quality(spark, d):
    """Ratios of labelled documents, under a model of all; only labelled ones are encoded."""
    docs, labels = spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "labels")
    codec.small_batches(spark)
    model = codec.fit(chunking.split(docs, ["doc_id"], "text", 4096))
    encoded, _ = codec.compress(docs.join(labels, "doc_id", "left_semi"), ["doc_id"], "text", model, pin=4096)
    return encoded.join(labels, "doc_id").groupBy("quality", "toxic").agg(metrics.ratio(F.col("comp_len"), F.col("orig_len")).alias("ratio"))


def gate_report(spark, d):
    """The gates over runs as they might be: coded sizes from chunk counts, fixed times."""
    sizes = table(spark, d, "documents", "lang", "text").groupBy("lang").agg(F.sum(F.octet_length("text")).cast("long").alias("orig"), F.count("*").alias("n"))
    runs = sizes.select("lang", F.floor(F.col("orig") / 10).cast("long").alias("comp"), "orig", F.lit(1.0).alias("encode_s"), F.lit(2.0).alias("decode_s"), (F.col("n") > 0).alias("exact"))
    return metrics.gates(runs).select("lang", F.round("ratio", 6).alias("ratio"), F.round("encode_kb_s", 4).alias("encode_kb_s"), F.round("decode_kb_s", 4).alias("decode_kb_s"), "ratio_ok", "encode_ok", "decode_ok", "passed")


def crc_check(spark, d):
    """Checksums of chunks as they were and with a bit of the payload flipped."""
    encoded, model = _packed(spark, d, "documents", ["doc_id"], "text", order=0)
    flip = F.concat(F.expr("substring(payload, 1, 8)"), F.unhex(F.hex(F.conv(F.hex(F.substring("payload", 9, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(128)))), F.expr("substring(payload, 10)"))
    # both forms of a chunk side by side, so that chunks are encoded once
    both = encoded.select("*", F.explode(F.array(F.struct(F.lit(False).alias("flipped"), F.col("payload").alias("form")), F.struct(F.lit(True).alias("flipped"), flip.alias("form")))).alias("x"))
    both = both.withColumns({"flipped": F.col("x.flipped"), "payload": F.col("x.form")})
    ok = codec.decode(both, model, ["doc_id", "flipped"]).groupBy("doc_id")
    return ok.agg(F.bool_and(F.when(~F.col("flipped"), F.col("crc_ok"))).alias("intact_ok"), F.bool_or(F.when(F.col("flipped"), F.col("crc_ok"))).alias("flipped_ok"))


def lossy_boundary_guard(spark, d):
    """Parts that begin within characters, split at 7 bytes, go through the coder unharmed."""
    raw = F.col("text").cast("binary")
    docs = spread(table(spark, d, "documents", "doc_id", "text")).select("doc_id", "text", F.octet_length("text").alias("n"))
    cut = sizing.quotient(F.col("n"), F.lit(2)).cast("int")
    parts = docs.select("doc_id", F.posexplode(F.array(raw.substr(F.lit(1), cut), raw.substr(cut + 1, F.col("n") - cut))).alias("part", "data"))
    encoded, model = codec.compress(parts, ["doc_id", "part"], "data", pin=997, order=0)
    back = codec.decompress(encoded, model, ["doc_id", "part"])
    whole = back.groupBy("doc_id").agg(assembly.in_order("data", "part").alias("data"), F.bool_and("crc_ok").alias("crc_ok"))
    return whole.select("doc_id", F.decode("data", "UTF-8").alias("text"), "crc_ok")


def truncated_valid_text(spark, d):
    """Texts cut to a number of bytes, and what is left of them as valid text."""
    raw = tokens.truncated(F.col("text").cast("binary"), F.lit(200))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.octet_length(raw).alias("n_bytes"), F.hex(raw).alias("hex"), tokens.valid_utf8(raw).isNotNull().alias("decodes"))
