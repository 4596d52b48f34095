import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkwise.functions import cdf, coder, framing, sizing, tokens
from chunkwise.operators import chunking, codec
from chunkwise.plans import launch
from chunkwise.sources import storage


@pytest.mark.parametrize("shape,seed", [((1, 4), 10), ((16, 64), 11), ((256, 256), 12), ((64, 5000), 13)])
def test_bounds_from_probabilities_and_back_through_the_coder(shape, seed):
    rng = np.random.default_rng(seed)
    bounds = cdf.from_probabilities(rng.random(shape) + 1e-6)
    assert (bounds[:, 0] == 0).all() and (bounds[:, -1] == cdf.TOTAL).all() and (np.diff(bounds) >= 1).all()
    symbols = rng.integers(0, shape[1], shape[0]).tolist()
    assert coder.decode(bounds, coder.encode(bounds, symbols), len(symbols)) == symbols


def test_one_symbol_has_nearly_all():
    counts = np.zeros((1, 100), int)
    counts[0, 7] = 10**9
    bounds = cdf.cumulative(counts)
    assert np.diff(bounds).min() == 1
    assert len(coder.encode(bounds[0], [7] * 2048)) < 512
    assert coder.decode(bounds[0], coder.encode(bounds[0], [3] * 50), 50) == [3] * 50


def test_nothing_counted_is_even():
    assert np.ptp(np.diff(cdf.cumulative(np.zeros((1, 256), int)))) <= 1 << 8


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), min_size=1, max_size=6), st.lists(st.integers(0, 1000), min_size=7, max_size=7))
def test_lockstep_gives_the_same_bits(streams, counts):
    bounds = cdf.cumulative([counts])
    arrays = [np.array(s, np.int64) for s in streams]
    data = coder.encode_many([bounds[0][a] for a in arrays], [bounds[0][a + 1] for a in arrays])
    assert data == [coder.encode(bounds[0], s) for s in streams]
    back = coder.decode_many(data, [len(s) for s in streams], bounds, lambda state, s: state)
    assert [b.tolist() for b in back] == streams


def test_coder_can_be_halted_and_resumed():
    bounds = cdf.cumulative([[5, 1, 1, 9]])[0].tolist()
    symbols = [int(s) for s in np.random.default_rng(1).integers(0, 4, 300)]
    one = coder.Encoder()
    for s in symbols[:120]:
        one.put(bounds[s], bounds[s + 1])
    two = coder.Encoder(one.low, one.high, one.pending, list(one.bits))
    for s in symbols[120:]:
        two.put(bounds[s], bounds[s + 1])
    assert two.finish() == coder.encode(bounds, symbols)


def test_header_and_damage():
    h = framing.Header(123456, 7, 0xDEADBEEF, 5)
    assert len(h.pack()) == 37 and framing.unpack_header(h.pack()) == h
    for bad in (b"", h.pack()[:36], b"XXXX" + h.pack()[4:], h.pack()[:4] + b"\x09" + h.pack()[5:]):
        with pytest.raises(framing.Damaged):
            framing.unpack_header(bad)
    blob = framing.Header(3, 1).pack() + framing.PAIR.pack(3, 2) + b"ab"
    assert [(n, p) for n, p, _ in framing.entries(blob, 1)] == [(3, b"ab")]
    for bad in (blob[:-1], blob + b"x"):
        with pytest.raises(framing.Damaged):
            list(framing.entries(bad, 1))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200), st.integers(1, 9))
def test_any_bytes_are_split_without_loss(raw, size):
    parts = chunking.split_bytes(raw, size)
    assert b"".join(parts) == raw and all(0 < len(p) <= size for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=100), st.integers(4, 12))
def test_texts_are_split_between_characters(text, size):
    assert "".join(p.decode() for p in chunking.split_bytes(text.encode(), size)) == text


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=5), st.integers(0, 2))
def test_codec_gives_back_any_bytes(chunks, order):
    model = codec.build_model(order, *chunking.byte_counts(chunks[:1], order))
    packed = codec.encode_chunks(chunks, model)
    assert codec.decode_chunks(packed, model) == chunks


def test_a_flipped_bit_is_seen():
    raw = np.random.default_rng(1).integers(65, 90, 1700).astype(np.uint8).tobytes()
    model = codec.build_model(1, *chunking.byte_counts([raw], 1))
    (packed,) = codec.encode_chunks([raw], model)
    at = 8 + (len(packed) - 8) // 2
    bad = packed[:at] + bytes([packed[at] ^ 1]) + packed[at + 1 :]
    assert zlib.crc32(codec.decode_chunks([bad], model)[0]) != zlib.crc32(raw)
    with pytest.raises(framing.Damaged):
        codec.decode_chunks([framing.PAIR.pack(3, 4) + b"x"], model)


def test_storage(tmp_path):
    url = f"{tmp_path}/a/b.bin"
    storage.write(url, b"0123456789")
    assert storage.size(url) == 10 and storage.read_all(url) == b"0123456789"
    assert storage.read_range(url, 2, 5) == b"234" and storage.read_range(url, 5, 5) == b"" and storage.read_range(f"file://{url}", 8, 99) == b"89"
    assert storage.part_name("x", 3) == "x.parts/part-000003"
    storage.delete(url)
    storage.delete(url)
    with pytest.raises(FileNotFoundError):
        storage.size(url)
    with pytest.raises(ValueError):
        storage.write("http://example.com/x", b"")


@pytest.mark.parametrize("target", sorted(launch.TEMPLATES))
def test_plans_render(target):
    values = {k: k for k in "master job_name memory shared_dir script mode input_url output_url image queue".split()} | {"executors": 4}
    text = launch.render(target, values)
    assert "{{" not in text and "job_name" in text
    with pytest.raises(ValueError, match="input_url"):
        launch.render(target, {k: v for k, v in values.items() if k != "input_url"})


def test_unknown_plan():
    with pytest.raises(ValueError):
        launch.render("nowhere", {})


def test_recurrence_at_once_is_that_of_single_steps():
    from chunkwise.operators import sequence

    rng = np.random.default_rng(4)
    k, v = rng.normal(0, 3, (200, 3)), rng.normal(0, 5, (200, 3))
    v[::7] = 0
    state, want = [sequence.FRESH] * 3, np.empty_like(v)
    for t in range(200):
        for c in range(3):
            want[t, c], state[c] = sequence.wkv_step(state[c], k[t, c], v[t, c], -0.05 - 0.1 * c, 0.3)
    w, own, at = np.array([-0.05, -0.15, -0.25]), sequence.fresh(3), 0
    for n in (1, 0, 50, 149):
        y, own = sequence.wkv_run(k[at : at + n], v[at : at + n], w, 0.3, own)
        assert np.allclose(y, want[at : at + n], rtol=1e-9, atol=1e-9)
        at += n
    assert np.allclose([s[0] / s[1] for s in state], own[0] / own[1])


def test_layer_in_runs_is_that_of_single_positions():
    from chunkwise.operators import sequence

    layer, x = sequence.Layer.of(4), np.random.default_rng(5).normal(0, 1, (30, 4))
    whole, _ = layer.run(x, layer.start())
    state, parts = layer.start(), []
    for t in range(30):
        scan, before, before2 = state
        h = layer.norm(x[t : t + 1])[0]
        k, v, r = (p @ (h * m + before * (1 - m)) for m, p in ((layer.mix_k, layer.key), (layer.mix_v, layer.value), (layer.mix_r, layer.gate)))
        y, new = zip(*(sequence.wkv_step(tuple(scan[:, c]), k[c], v[c], layer.decay[c], layer.bonus[c]) for c in range(4)))
        a = x[t] + layer.out @ (1 / (1 + np.exp(-r)) * np.array(y))
        h2 = layer.norm(a[None])[0]
        mixed = [h2 * m + before2 * (1 - m) for m in (layer.mix_k, layer.mix_r)]
        parts.append(a + 1 / (1 + np.exp(-(layer.gate2 @ mixed[1]))) * (layer.narrow @ np.maximum(layer.wide @ mixed[0], 0) ** 2))
        state = np.array(new).T, h, h2
    assert np.allclose(whole, parts, rtol=1e-8)


def test_batches_of_chunks(spark):
    for n in (0, 1, 7, 100):
        assert spark.range(1).select(sizing.decode_batches(F.lit(n), 2, 4)).first()[0] == sizing.decode_batch(n, 2, 4)
    assert sizing.decode_batch(1000, 8, 8, memory=10_000_000) == 5


def test_symbol_counts_on_odd_rows(spark):
    df = spark.createDataFrame([("a", "xy\U0001f600x"), ("a", None), (None, "x"), ("b", "")], "g string, t string")
    assert {tuple(r) for r in tokens.symbol_counts(df, ["g"], "t").collect()} == {("a", 120, 2), ("a", 121, 1), ("a", 0x1F600, 1), (None, 120, 1)}
    assert {tuple(r) for r in tokens.symbol_counts(df, ["g"], "t", pairs=True).collect()} == {("a", 0, 120, 1), ("a", 120, 121, 1), ("a", 121, 0x1F600, 1), ("a", 0x1F600, 120, 1), (None, 0, 120, 1)}
    assert tokens.symbol_counts(df.limit(0), ["g"], "t").count() == 0


def test_running_totals_over_stretches(spark):
    from chunkwise.operators import offsets

    rng = np.random.default_rng(3)
    rows = [(None if k % 9 == 0 else f"g{k % 3}", int(o), int(v)) for k, (o, v) in enumerate(zip(rng.permutation(400) - 50, rng.integers(0, 99, 400)))]
    got = {(r["g"], r["o"]): r["t"] for r in offsets.running_total(spark.createDataFrame(rows, "g string, o long, v long"), ["g"], "o", "v", "t", 32).collect()}
    assert got == {(g, o): sum(v for h, p, v in rows if h == g and p < o) for g, o, _ in rows}


def test_symbols_are_counted_in_bounded_memory(spark, monkeypatch):
    """A batch of 4 M symbols, and a text that is longer than what is counted together."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    rng, seen = np.random.default_rng(4), []
    texts = ["".join(map(chr, rng.choice([97, 98, 0xE9, 0x4E2D, 0x1F600], n))) for n in [700_000, *[30_000] * 110, 0, 1]]
    df = spark.createDataFrame([("a", texts[0]), ("b", texts[1]), ("a", ""), ("b", None)], "g string, t string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *rest, own=type(df).mapInArrow: seen.append(f) or own(self, f, *rest))
    want = Counter((g, a, b) for g, t in (("a", texts[0]), ("b", texts[1])) for a, b in zip([0, *map(ord, t)], map(ord, t)))
    assert {tuple(r[:3]): r[3] for r in tokens.symbol_counts(df, ["g"], "t", pairs=True).collect()} == want
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * len(texts)), pa.array(texts)], names=["g", "t"])
    tracemalloc.start()
    got = sum(sum(b.column(3).to_pylist()) for b in seen[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sum(map(len, texts)) and peak < 100e6
    raw = spark.createDataFrame([(1, b"\x00\x01\x01\xff"), (2, b"")], "k long, t binary")
    assert {tuple(r) for r in tokens.symbol_counts(raw, ["k"], "t").collect()} == {(1, 0, 1), (1, 1, 2), (1, 255, 1)}


def test_streams_summed_up_carry_as_those_of_one_coder(monkeypatch):
    """Shares about the middle, where bits stay open for long, likely symbols that settle none, and streams put together in several goes."""
    from chunkwise.functions.cdf import TOTAL

    monkeypatch.setattr(coder, "SUMMED", 50)
    rng, half = np.random.default_rng(8), TOTAL // 2
    rows = {"middle": [0, half - 1, half + 1, TOTAL], "ends": [0, 1, TOTAL - 1, TOTAL], "even": [0, TOTAL // 3, 2 * TOTAL // 3, TOTAL]}
    for bounds in map(np.array, rows.values()):
        for p in ([0, 1, 0], [0.01, 0.98, 0.01], [0.3, 0.3, 0.4]):
            streams = [rng.choice(3, n, p=p) for n in (0, 1, 300, 7, 0, 64)]
            data = coder.encode_many([bounds[s] for s in streams], [bounds[s + 1] for s in streams])
            assert data == [coder.encode(bounds, s) for s in streams]
            back = coder.decode_many(data, [len(s) for s in streams], bounds[None], lambda state, s: state)
            assert [s.tolist() for s in back] == [s.tolist() for s in streams]


def test_chunks_go_through_the_coder_in_bounded_memory():
    """16 MB in chunks of 2 KB, a longer one among them, and noise, which settles most bits."""
    import tracemalloc

    rng = np.random.default_rng(1)
    text = bytes(rng.choice(np.frombuffer(b"aaabbc de fgh\n", np.uint8), 1 << 20))
    data = [text[k * 100 : k * 100 + 2000] for k in range(8000)] + [text[:9000], *[rng.bytes(1000)] * 8, b""]
    model = codec.build_model(1, *chunking.byte_counts(data[:4], 1))
    tracemalloc.start()
    packed = codec.encode_chunks(data, model)
    back = codec.decode_chunks(packed, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back == data and peak < 400e6
