"""Scoring, classifying, decoding and mixing."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chunkwise.llm import decontam, flac, line_dedup, lm_score, mixing, ngram_join, quality
from chunkwise.llm.common import table

from .. import oracle
from . import cases

SF = oracle.SF


def _ways(word, vocabulary):
    """Probabilities of all segmentations of a word, one by one."""
    known = dict(zip(vocabulary.pieces, vocabulary.logp))

    def go(s):
        if not s:
            yield 0.0, ()
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                w = known[s[:n]]
            elif n == 1:
                w = sum(vocabulary.byte_logp[b] for b in s[:1].encode())
            else:
                continue
            for rest, used in go(s[n:]):
                yield w + rest, (s[:n], *used)

    return list(go(lm_score.MARK + word))


def _small():
    pieces = [lm_score.MARK, "a", "b", "ab", "aba", lm_score.MARK + "a", "ba", "bb"]
    return lm_score.Vocabulary(pieces, np.log(np.arange(1, 9) / 40), np.full(256, np.log(0.1 / 256)))


def test_marginals_are_sums_over_all_segmentations():
    v = _small()
    words = ["a", "ab", "abab", "bbabab", "zé", "abz", "b" * 9, ""]
    want = [math.log(sum(math.exp(w) for w, _ in _ways(x, v))) for x in words]
    assert np.allclose(lm_score.word_scores(words, v)[0], want)


def test_expected_counts_are_those_of_all_segmentations():
    v, words, counts = _small(), ["abab", "zb", "bbab"], np.array([2.0, 1.0, 3.0])
    want = defaultdict(float)
    for w, c in zip(words, counts):
        ways = _ways(w, v)
        total = sum(math.exp(p) for p, _ in ways)
        for p, used in ways:
            for piece in used:
                want[piece] += c * math.exp(p) / total
    got = lm_score.expected_counts(words, counts, v)
    assert all(math.isclose(got[i], want[p], abs_tol=1e-9) for i, p in enumerate(v.pieces))
    assert math.isclose(got[len(v.pieces) + ord("z")], want["z"])


def test_long_words_are_scored_like_others(monkeypatch):
    monkeypatch.setattr(lm_score, "WINDOW", 7)
    v, words, counts = _small(), ["abab", "zbé", "bbababab" * 5, "a" * 31, "b"], np.array([2.0, 1.0, 3.0, 1.0, 4.0])
    want, uses = lm_score.word_scores(words, v), lm_score.expected_counts(words, counts, v)
    monkeypatch.setattr(lm_score, "LONG", 4)
    assert np.allclose(lm_score.word_scores(words, v), want) and np.allclose(lm_score.expected_counts(words, counts, v), uses)


def test_forgetting_rare_words_changes_no_score(monkeypatch):
    import pyarrow as pa

    class Sent:
        value = ("some key", _small(), _small())

    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(12)) for _ in range(60)] + [None, ""]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string())], names=["doc_id", "text"]) for t in (texts[i : i + 5] for i in range(0, len(texts), 5))]
    want = [b.to_pylist() for b in lm_score._scorer(Sent)(iter(batches))]
    lm_score._known.clear()
    monkeypatch.setattr(lm_score, "REMEMBERED", 20)
    assert [b.to_pylist() for b in lm_score._scorer(Sent)(iter(batches))] == want


def test_a_text_without_blanks_takes_bounded_memory():
    import tracemalloc

    v = lm_score.load_vocabulary(lm_score.VOCABULARY)
    tracemalloc.start()
    out = lm_score.word_scores(["unbroken" * 40_000], v)
    assert out[0, 0] < -1e5 and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_scores_on_odd_tables(spark):
    df = cases.odd(spark)
    rows = lm_score.lm_score(df, lm_score.VOCABULARY).collect()
    assert len(rows) == df.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["logprob"] is None and by[2]["logprob"] == 0 and by[2]["bits_per_char"] is None and by[3]["n_words"] == 0
    assert math.isclose(by[4]["logprob"], 8000 * sum(_fitted_word(spark, df, w) for w in ("very", "long", "text")), rel_tol=1e-9)
    assert lm_score.lm_score(cases.empty(spark), lm_score.VOCABULARY).count() == 0


def _fitted_word(spark, df, word):
    return lm_score.word_scores([word], lm_score.fit_scores(df, lm_score.load_vocabulary(lm_score.VOCABULARY)))[0][0]


def test_fitted_scores_suit_the_corpus(spark):
    r = lm_score.query(spark, SF).agg(F.sum("logprob").alias("own"), F.sum("prior_logprob").alias("base"), F.count("*").alias("n")).first()
    assert r["own"] > r["base"] and r["n"] == table(spark, SF, "documents").count()


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    seen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    held = labels.join(seen, "doc_id", "left_anti")
    got = quality.score(docs, seen).join(held, "doc_id").select("keep", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    n, right = got.count(), got.where("keep = good").count()
    assert right / n > 0.85


def test_quality_on_odd_tables(spark):
    df = cases.odd(spark)
    labels = spark.createDataFrame([(5, 1, 0), (4, 0, 0), (None, 1, 0), (2, None, 1), (6, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(df, labels).count() == df.count()
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.score(cases.empty(spark), labels).count() == 0
    assert {round(r["score"], 3) for r in quality.score(df, labels.limit(0)).collect()} == {0.5}


def test_quality_learns_from_documents_whose_labels_are_not_used(spark, monkeypatch):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("id") % 2).alias("source"))
    labels = docs.select("doc_id", F.expr("cast(doc_id % 2 as int)").alias("quality"), F.lit(0).alias("toxic"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 1, F.lit("calm clear prose of plain words " * 9)).otherwise(F.lit("BUY!!! $$$ cheap pills now " * 9)))
    fits, fit = [], quality._fit
    monkeypatch.setattr(quality, "_fit", lambda data, *more: fits.append(len(data.scale)) or fit(data, *more))
    quality.score(docs, labels, max_labelled=600)
    assert len(fits) == 2 * (quality.ROUNDS + 1) and max(fits) > fits[0] == 480


def test_quality_chooses_among_all_documents(spark):
    docs = table(spark, SF, "documents").dropDuplicates(["doc_id"])
    once = quality._feature_table(docs)
    twice = quality._feature_table(docs.unionByName(docs).unionByName(docs.where("doc_id % 7 = 3")))
    rng = np.random.default_rng(3)
    views = [quality.View(rng.normal(0, 3, 1 << bits).astype(np.float32), 0.0) for bits in (quality.WORD_BITS, quality.META_BITS)]
    rows = once.toArrow()
    parts, keys = quality._rows([rows[c] for c in ("words", "meta", "n")]), rows["key"].to_pylist()
    for taken in ([], keys[:50]):
        got = quality._surest(twice)(views, [np.array(taken, np.int64)] * 2, {1: 20, 0: 10})
        for k in (0, 1):
            logit = views[k].logit(parts[k].raw(views[k]))
            for label, n in ((1, 20), (0, 10)):
                sure = sorted((-s, key) for s, key in zip(logit if label else -logit, keys) if key not in taken and quality._sigmoid(s) >= quality.SURE)
                assert [key for key, own in zip(got[k]["key"].to_pylist(), got[k]["label"].to_pylist()) if own == label] == sorted(key for _, key in sure[:n])


def _signal(rng, n, channels, bits):
    t = np.arange(n)
    x = np.stack([0.4 * np.sin(t / (5 + c)) + rng.choice([0, 0.01, 0.1]) * rng.standard_normal(n) for c in range(channels)], axis=1)
    return np.clip(np.round(x * (1 << bits - 1)), -(1 << bits - 1), (1 << bits - 1) - 1).astype(np.int64)


@pytest.mark.parametrize("bits", [8, 12, 16, 20, 24])
@pytest.mark.parametrize("stereo", [0, 8, 9, 10])
def test_flac_round_trip(bits, stereo):
    rng = np.random.default_rng(bits + stereo)
    for n, block, order, parts in ((1, 16, 0, 0), (50, 16, 4, 1), (3000, 192, 8, 3), (5000, 4096, 12, 2)):
        x = _signal(rng, n, 2, bits)
        info, y = flac.decode(flac.encode(x, 44100, bits, block, order, parts, stereo))
        assert (y == x).all() and info.total == n and info.rate == 44100 and info.bits == bits


def test_flac_special_subframes():
    rng = np.random.default_rng(0)
    for x in (np.full(100, -7), np.arange(100) * 8, rng.integers(-32768, 32768, 400), np.zeros(40)):
        x = np.asarray(x, np.int64)[:, None]
        assert (flac.decode(flac.encode(x, block=64))[1] == x).all()
    import hashlib

    x = _signal(rng, 200, 1, 16)
    data = flac.encode(x)
    assert flac.stream_info(data).md5 == hashlib.md5(x.astype("<i2").tobytes()).digest()


def _rows_of(streams):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(streams)), pa.int64()), pa.array(streams, pa.binary())], names=["media_id", "flac"])
    return sorted((r for b in flac._decode_batches(iter([batch])) for r in b.to_pylist()), key=lambda r: (r["media_id"], r["byte_offset"]))


def test_flac_streams_in_lockstep_are_decoded_as_alone(monkeypatch):
    from chunkwise.llm import flac_lanes

    rng, streams = np.random.default_rng(12), [b"", b"no stream"]
    for bits in (8, 16, 24):
        for channels, stereo in ((1, 0), (2, 0), (2, 8), (2, 9), (2, 10), (3, 0)):
            for n, block, order, parts in ((1, 16, 0, 0), (50, 16, 4, 1), (700, 192, 8, 3), (2600, 20, 2, 1)):
                streams.append(flac.encode(_signal(rng, n, channels, bits), 44100, bits, block, order, parts, stereo))
    for x in (np.full(100, -7), np.arange(100) * 8, rng.integers(-32768, 32768, 100), np.zeros(40), np.arange(300) % 2 * 60000 - 30000):
        streams.append(flac.encode(np.asarray(x, np.int64)[:, None], block=64))
    for k in range(60):
        bad = bytearray(streams[int(rng.integers(2, 60))])
        bad[int(rng.integers(len(bad)))] ^= 1 << int(rng.integers(8))
        streams.append(bytes(bad[: int(rng.integers(len(bad)))] if k % 3 == 0 else bad))
    together = _rows_of(streams)
    alone = flac_lanes.Lanes.frames
    monkeypatch.setattr(flac_lanes, "SHORT", -1)
    assert together == _rows_of(streams) and len(together) > 1000
    monkeypatch.setattr(flac_lanes, "SHORT", 1 << 15)
    done = []
    monkeypatch.setattr(flac_lanes.Lanes, "frames", lambda self: done.append(self) or alone(self))
    _rows_of(streams[2:70])
    assert sum(int((~x.bad).sum()) for x in done) > 60


def test_flac_signals_written_together_come_back():
    rng = np.random.default_rng(13)
    signals = [_signal(rng, int(n), 1, 16)[:, 0] for n in rng.integers(0, 90, 200)] + [np.zeros(64, np.int64), np.arange(64) * 4, rng.integers(-32768, 32768, 64)]
    for x, data in zip(signals, flac.encode_many(signals)):
        assert (flac.decode(data)[1][:, 0] == x).all() if len(x) else flac.stream_info(data).total == 0


def test_flac_damage_and_seeking(spark):
    x = _signal(np.random.default_rng(2), 1000, 1, 16)
    data = flac.encode(x, block=100, order=4)
    at = next(f.start for f in flac.parse(data)[1] if f.first == 300)
    bad = bytearray(data)
    bad[at + 20] ^= 1
    df = spark.createDataFrame([(1, bytes(data)), (2, bytes(bad)), (3, b"no"), (4, None), (5, b""), (None, bytes(data)), (1, bytes(data))], "media_id long, flac binary").withColumn("pcm", F.lit(1)).withColumn("block", F.lit(2))
    blocks = flac.decode_blocks(df).cache()
    rows = [r for r in blocks.collect() if r["media_id"] == 2]
    assert [r["first_sample"] for r in rows if r["crc_ok"]] == [k for k in range(0, 1000, 100) if k != 300]
    assert [r["error"] for r in rows if not r["crc_ok"]] != []
    assert [(r["crc_ok"], r["block"]) for r in blocks.collect() if r["media_id"] == 3] == [(False, None)]
    assert blocks.where("media_id in (4, 5)").count() == 0 and blocks.where("media_id = 1").count() == 20
    found = sorted(flac.seek(blocks.where("media_id is null"), 250, 420).collect(), key=lambda r: r["first_sample"])
    assert b"".join(bytes(r["pcm"]) for r in found) == x[200:500].astype("<i2").tobytes()
    for r in found:
        assert data[r["byte_offset"] : r["byte_offset"] + 2] == b"\xff\xf8"
    assert flac.decode_blocks(df.limit(0)).count() == 0


def test_flac_query_agrees_with_its_sql(spark):
    assert oracle.from_spark(flac.query(spark, SF)) == oracle.from_sql(flac.SQL)


def test_budgets_are_those_of_filling_every_family_to_one_level():
    """Each family's children are filled to a common level for a unit of weight, found by bisection, as far as they can take it."""
    import random

    rng = random.Random(5)

    def filled(amount, wants, weights):
        low, high = 0.0, 1e12
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(wants[k], mid * weights[k]) for k in wants) < amount else (low, mid)
        return {k: min(wants[k], high * weights[k]) for k in wants}

    for _ in range(60):
        supply = {(f"d{rng.randrange(3)}", f"l{rng.randrange(3)}", f"s{k}"): rng.choice([0, 1, rng.randrange(50), rng.randrange(5000)]) for k in range(rng.randrange(1, 14))}
        weights = {p[:n]: rng.choice([1, 0.1, 3.5, 20]) for p in supply for n in (1, 2, 3) if rng.random() < 0.7}
        total = rng.randrange(1, 1 + sum(supply.values()) + 50)
        got = mixing.budgets(supply, total, weights)
        assert sum(got.values()) == min(total, sum(supply.values())) and all(0 <= got[k] <= supply[k] for k in supply)
        for depth in (0, 1, 2):
            for family in {p[:depth] for p in supply}:
                below = lambda m: {c: sum(n for p, n in m.items() if p[: depth + 1] == c) for c in {p[: depth + 1] for p in supply if p[:depth] == family}}  # noqa: E731, B023
                have, wants = below(got), below(supply)
                want = filled(sum(have.values()), wants, {c: weights.get(c, 1.0) for c in wants})
                assert all(abs(have[c] - want[c]) <= 1 for c in have)


def test_budgets_share_among_siblings_first():
    supply = {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}
    assert mixing.budgets(supply, 100, {("a",): 1, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1}) == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    assert mixing.budgets({("a", "x"): 10, ("b", "z"): 100}, 60, {}) == {("a", "x"): 10, ("b", "z"): 50}
    assert mixing.budgets(supply, 1000, {}) == supply and mixing.budgets({}, 5, {}) == {}


def test_mixture_against_brute_force(spark):
    import hashlib

    docs = table(spark, SF, "documents").collect()
    leaf = lambda r: ("reference" if r["source"] in mixing.REFERENCE_SOURCES else "web", r["lang"], r["source"])
    supply, total = Counter(), 0
    for r in docs:
        n = len(r["text"].split())
        supply[leaf(r)] += n
        total += n
    plan = mixing.budgets({k: 2 * n for k, n in supply.items()}, int(mixing.SHARE * total), mixing.WEIGHTS)
    want = Counter()
    for k, budget in plan.items():
        used = 0
        for epoch in range(mixing.EPOCHS):
            own = sorted((hashlib.md5(f"{mixing.SEED}:{epoch}:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], len(r["text"].split())) for r in docs if leaf(r) == k)
            for _, d, n in own:
                used += n
                if n and used <= budget:
                    want[(d, epoch)] += 1
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.query(spark, SF).collect())
    assert got == want


def test_mixing_on_odd_tables(spark):
    out = mixing.mixture(cases.odd(spark), total=10**9)
    got = Counter(r["doc_id"] for r in out.collect())
    assert got == {4: 2, 5: 4, 6: 4}
    assert mixing.mixture(cases.empty(spark)).count() == 0


def test_exchange_changes_what_the_views_know(spark):
    """Words that no used label shows are learnt from documents of which the metadata is sure."""
    rows = []
    for d in range(1800):
        good, rare = d % 2, d >= 600 and d % 3 == 0
        word = (("kind", "fine")[d % 4 // 2] if rare else "calm") if good else (("foul", "vile")[d % 4 // 2] if rare else "junk")
        rows.append((d, " ".join([word] * 8), "en" if good else "xx", f"src{good}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.where("doc_id < 600").selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "0 toxic")
    features = quality._feature_table(docs)
    slot = lambda word: int(quality._unpacked(features.sparkSession.createDataFrame([(0, word, "en", "s")], docs.schema).transform(quality._feature_table).toArrow()["words"])[0].max())
    once, full = (quality.fit(features, labels, rounds=r).text.weights for r in (0, 3))
    own = [(slot("kind"), slot("foul")), (slot("fine"), slot("vile"))]
    assert all(not once[a] and not once[b] for a, b in own)
    assert all(full[a] > 0 > full[b] for a, b in own)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_and_empty_tables(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    for docs in (cases.odd(spark), cases.odd(spark).drop("n_chars"), cases.empty(spark), cases.odd(spark).withColumn("epoch", F.lit("x"))):
        out = stage(spark, docs, SF)
        ids = {r[0] for r in docs.select("doc_id").collect()}
        got = out.collect()
        assert {r["doc_id"] for r in got} <= ids
        if k < 4:
            assert out.columns == docs.columns
        else:
            assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 3
            assert all(r["doc_id"] is not None for r in got)
    if 0 < k < 4:
        assert any(r["doc_id"] is None for r in stage(spark, cases.odd(spark), SF).collect())


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append((name, docs))
    return out


def test_pipeline_keeps_columns_and_narrows_down(spark, stages):
    before = table(spark, SF, "documents")
    for _, docs in stages[:-1]:
        assert docs.columns == before.columns
        assert {r[0] for r in docs.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        before = docs


def test_pipeline_stages_do_what_their_operators_say(spark, stages):
    kept, fresh, distinct, clean, mixed = (d for _, d in stages)
    good = quality.score(table(spark, SF, "documents"), table(spark, SF, "labels")).where("keep")
    assert cases.tuples(kept, "doc_id") == cases.tuples(good, "doc_id")
    seen, want = set(), {}
    for r in sorted(kept.collect(), key=lambda r: r["doc_id"]):
        lines = []
        for line in (r["text"] or "").split("\n"):
            if not line.strip(" ") or line.strip(" ") not in seen:
                lines.append(line)
            seen.add(line.strip(" "))
        if "\n".join(lines).strip():
            want[r["doc_id"]] = "\n".join(lines)
    assert {r["doc_id"]: r["text"] for r in fresh.collect()} == want
    assert ngram_join.jaccard_classes(distinct).where("n_links > 0").count() == 0
    assert decontam.contamination(clean, table(spark, SF, "benchmark")).count() == 0
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in mixing.mixture(clean).collect())
    assert line_dedup.keep_bitmaps(clean).where("n_kept < n_lines").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    assert cases.tuples(corpus_pipeline.run(spark, SF), "doc_id", "epoch") == cases.tuples(stages[-1][1], "doc_id", "epoch")
