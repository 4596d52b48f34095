"""Operators that look for things in texts: against brute force, and on odd tables."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from chunkwise.llm import decontam, licenses, line_dedup, ngram_join, pii, suffix_dedup
from chunkwise.llm.common import hashed_words, shingle_hashes, word_hashes
from chunkwise.llm.components import components

from .. import oracle
from . import cases

SF = oracle.SF


@pytest.mark.parametrize("module", [line_dedup, suffix_dedup, ngram_join, decontam])
def test_query_agrees_with_its_sql(spark, module):
    assert oracle.from_spark(module.query(spark, SF)) == oracle.from_sql(module.SQL)


def test_line_dedup_on_odd_tables(spark):
    got = {r["doc_id"]: (r["n_lines"], r["n_kept"], list(r["runs"])) for r in line_dedup.keep_bitmaps(cases.odd(spark).where("doc_id <> 6 or text like 'Same%'")).collect()}
    assert got[5] == (2, 2, [2]) and got[6] == (2, 1, [0, 1, 1]) and got[1] == (1, 1, [1]) and got[3] == (3, 3, [3])
    assert None not in got and line_dedup.keep_bitmaps(cases.empty(spark)).count() == 0
    kept = line_dedup.drop_repeated_lines(cases.odd(spark).where("doc_id <> 6 or text like 'Same%'"))
    assert kept.columns == cases.odd(spark).columns
    assert cases.tuples(kept.where("doc_id = 6"), "text", "n_chars") == [("A third one.", 12)]


def test_line_dedup_settles_frequent_lines_of_a_task_on_the_spot():
    import pyarrow as pa

    rng = random.Random(9)
    rows = [(rng.choice([1, 2, 3]) if rng.random() < 0.5 else rng.randrange(10**6), 5, d, rng.randrange(3), 3, 0) for d in rng.sample(range(4000), 4000)]
    rows += rows[:50]
    names = ["k1", "k2", "doc_id", "pos", "n_lines", "known"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 300]]) for i in range(0, len(rows), 300)]
    out = [r for b in line_dedup._spread(iter(batches)) for r in b.to_pylist()]
    sent = [r for r in out if r["known"] == 0 and r["k1"] in (1, 2, 3)]
    assert len(out) == len(rows) and len(sent) < 150
    least = {}
    for k, _, d, p, *_ in rows:
        least[k] = min(least.get(k, (d, p)), (d, p))
    assert not [r for r in out if r["known"] and (r["doc_id"], r["pos"]) in least.values()]


def _repeats(rows, least):
    counts, texts = Counter(), sorted({(d, t) for d, t in rows if d is not None and t is not None})
    for _, t in texts:
        w = t.split()
        counts.update(tuple(w[i : i + least]) for i in range(len(w) - least + 1))
    out = []
    for d, t in texts:
        w, spans = t.split(), []
        for i in range(len(w) - least + 1):
            if counts[tuple(w[i : i + least])] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + least
                else:
                    spans.append([i, i + least])
        out += [(d, *s) for s in spans]
    return sorted(out)


@pytest.mark.parametrize("base, part", [(60, 100), (60, 1 << 19), (1 << 20, 1 << 19)])
def test_suffix_array_finds_all_repeats(spark, monkeypatch, base, part):
    monkeypatch.setattr(suffix_dedup, "BASE", base)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rng = random.Random(3)
    words = lambda n, v: [f"w{rng.randrange(v)}" for _ in range(n)]
    shared = [words(rng.randrange(8, 40), 50) for _ in range(5)]
    rows = []
    for d in range(40):
        w = []
        for _ in range(rng.randrange(6)):
            w += words(rng.randrange(20), 3 if d % 5 == 0 else 60) + (shared[rng.randrange(5)] if rng.random() < 0.5 else [])
        rows.append((d, " ".join(w)))
    rows += [(100, rows[3][1]), (7, rows[9][1]), (7, rows[9][1]), (104, "x " * 60)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 8, 3)
    assert cases.tuples(got, "doc_id", "start_word", "end_word") == sorted(_repeats(rows, 8), key=str)


def test_words_are_what_white_space_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BYTES", 50)
    rng = random.Random(6)
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["".join(rng.choice([*"ab\u00e9\u20ac\u0105\u2013\u2010\U0001f600", rng.choice(spaces)]) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", " ", "a" * 300, "".join(spaces)]
    codes, lengths = suffix_dedup.word_codes(pa.array([*texts, None]))
    words = [t.split() for t in texts]
    assert lengths.tolist() == [*map(len, words), 0]
    pairs = list(zip((w for own in words for w in own), codes.tolist()))
    assert len(set(pairs)) == len({w for w, _ in pairs}) == len({c for _, c in pairs}) and all(c % 2 for _, c in pairs)


def test_suffix_order_is_that_of_sorting():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    strings = [np.append(rng.integers(0, 3, rng.integers(1, 40)) * 2 + 1, 1000 + 2 * k) for k in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30), pa.int64()), pa.array([s.astype(np.int64).tobytes() for s in strings], pa.binary())], names=["sid", "syms"])
    (out,) = suffix_dedup._ordered(iter([batch]))
    ranks = {(k, i): r for k, b in enumerate(out.column(1).to_pylist()) for i, r in enumerate(np.frombuffer(b, np.int64).tolist())}
    assert sorted(ranks, key=ranks.get) == sorted(ranks, key=lambda p: strings[p[0]][p[1] :].tolist())


def test_suffix_dedup_on_odd_tables(spark):
    got = cases.tuples(suffix_dedup.repeated_passages(cases.odd(spark)), "doc_id", "start_word", "end_word")
    assert got == [(4, 0, 24000)]
    assert suffix_dedup.repeated_passages(cases.empty(spark)).count() == 0
    twice = cases.odd(spark, [(9, cases.LONG, "en", "s"), (9, cases.LONG, "en", "s")])
    assert cases.tuples(suffix_dedup.repeated_passages(twice), "doc_id", "start_word", "end_word") == [(4, 0, 24000), (9, 0, 24000)]


def test_join_on_odd_tables(spark):
    near = " ".join(f"word{i}" for i in range(100))
    df = cases.odd(spark, [(20, near, "en", "s"), (21, near + " more", "en", "s"), (22, near, "de", "s")])
    got = cases.tuples(ngram_join.jaccard_classes(df), "doc_id", "class_id", "n_links")
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (6, 6, 0), (20, 20, 2), (21, 20, 2), (22, 20, 2)], key=str)
    assert ngram_join.jaccard_classes(cases.empty(spark)).count() == 0
    left = ngram_join.one_of_each_group(df)
    assert left.columns == df.columns and not {21, 22} & {r["doc_id"] for r in left.collect()} and left.count() == df.count() - 2


def test_join_split_into_tiles_agrees_with_its_sql(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 1)
    monkeypatch.setattr(ngram_join, "TILE_TOKENS", 700)
    assert oracle.from_spark(ngram_join.query(spark, SF)) == oracle.from_sql(ngram_join.SQL)


def test_join_of_copies_of_all_degrees_against_brute_force(spark):
    """Exact copies, near copies and rows that repeat, near the threshold and away from it."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(12)]
    rows = []
    for d in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 9) if d % 4 else 0):
            w[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        rows.append((d, " ".join(w)))
    rows += [rows[3], rows[3], (900, rows[5][1]), (901, rows[5][1])]
    sets = {(d, frozenset(zip(t.split(), t.split()[1:], t.split()[2:]))) for d, t in rows}
    links = {x: [y for y in sets if y != x and 2 * len(x[1] & y[1]) >= len(x[1] | y[1])] for x in sets}
    least = {x: x[0] for x in sets}
    for _ in range(10):
        least = {x: min([least[x], *(least[y] for y in own)]) for x, own in links.items()}
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert cases.tuples(got, "doc_id", "class_id", "n_links") == sorted(((x[0], least[x], len(own)) for x, own in links.items()), key=str)


def _apart(spark, n, shared, seed=0):
    """Two texts of n n-grams each, `shared` of them in common: those have high hashes, all others low ones, so that the first n-grams of both differ."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(seed)
    hashes = spark.range(4000).select(F.concat(F.lit("x"), "id").alias("w")).select("w", F.xxhash64("w").alias("h")).collect()

    def longer(words, high, many):
        while many:
            word = hashes[rng.integers(len(hashes))]
            last = [*words[-2:], word]
            token, _ = shingle_hashes(np.array([w["h"] for w in last]), np.array([0, len(last)]), 3)
            if len(last) < 3 or (token[0] >> np.uint64(63) == 1) == high:
                many -= len(last) == 3
                words = [*words, word]
        return words

    common = longer([], True, shared)
    return [" ".join(w["w"] for w in longer(common, False, n - shared)) for _ in range(2)]


def test_join_finds_pairs_that_have_none_of_their_first_tokens_in_common(spark):
    rows, want = [], []
    for k, (n, shared) in enumerate([(30, 20), (120, 80), (300, 200), (90, 59)]):  # the last is just below the threshold
        a, b = _apart(spark, n, shared, k)
        rows += [(10 * k, a), (10 * k + 1, b), (10 * k + 2, b)]
        near = 2 * shared >= 2 * n - shared
        want += [(10 * k, 10 * k, 2 * near), (10 * k + 1, 10 * k + (not near), 1 + near), (10 * k + 2, 10 * k + (not near), 1 + near)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert cases.tuples(got, "doc_id", "class_id", "n_links") == sorted(want, key=str)


def test_pipeline_leaves_one_of_documents_without_first_tokens_in_common(spark):
    a, b = _apart(spark, 120, 80)
    df = cases.odd(spark, [(20, a, "en", "s"), (21, b, "en", "s"), (22, b, "de", "s")])
    left = corpus_pipeline.distinct_documents(spark, df, SF)
    assert left.columns == df.columns and cases.tuples(left, "doc_id") == cases.tuples(df.where("doc_id is null or doc_id not in (21, 22)"), "doc_id")


def test_pipeline_leaves_no_near_documents_under_ids_that_repeat(spark):
    near = " ".join(f"word{i}" for i in range(100))
    rows = [(20, near, "en", "s"), (21, near + " more", "en", "s"), (21, "another text of that id", "en", "s"), (21, None, "en", "s"), (22, "its own text here", "de", "s"), (22, near, "en", "s")]
    rows += [(23, "first " + near.replace("word", "w"), "en", "s"), (23, near.replace("word", "w"), "en", "s"), (24, near, "en", "s"), (24, near + " more", "en", "s")]
    df = cases.odd(spark, rows)
    left = corpus_pipeline.distinct_documents(spark, df, SF)
    assert left.columns == df.columns and ngram_join.jaccard_classes(left).where("n_links > 0").count() == 0
    got = Counter((r["doc_id"], r["text"]) for r in left.collect() if (r["doc_id"] or 0) >= 20)
    texts = [text for d, text in got if d == 23]
    assert len(texts) == 1 and (23, texts[0]) in [r[:2] for r in rows]
    assert got == Counter([rows[0][:2], *(r[:2] for r in rows[2:5]), (23, texts[0])])
    assert left.count() - got.total() == cases.odd(spark).count()


def test_join_at_low_thresholds_meets_sets_of_unlike_size(spark):
    words = [f"w{i}" for i in range(302)]
    rows = [(1, " ".join(words[:92])), (2, " ".join(words))]  # 90 of 300 n-grams
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert cases.tuples(ngram_join.jaccard_classes(df, threshold=0.3), "doc_id", "class_id", "n_links") == [(1, 1, 1), (2, 1, 1)]
    assert ngram_join.jaccard_classes(df, threshold=0.31).where("n_links > 0").count() == 0


def test_join_loses_no_pair_where_tokens_are_alike(monkeypatch):
    """The second step by itself, with places of so few bits that sets have tokens that count as one."""
    import pyarrow as pa

    ranges, within, rng = 3, ngram_join._within, np.random.default_rng(3)
    monkeypatch.setattr(ngram_join, "_within", lambda h, ranges: within(h, ranges) >> np.uint32(16))
    pool = np.unique(rng.integers(0, 1 << 62, 3000))
    tokens = shingle_hashes(pool, np.arange(len(pool) + 1), 1)[0]
    place = ngram_join._range(tokens, ranges) << 32 | ngram_join._within(tokens, ranges).astype(np.int64)
    values, which, many = np.unique(place, return_inverse=True, return_counts=True)
    pair, rest = pool[place == values[many == 2][0]], pool[many[which] == 1]
    own, others, further = np.append(pair, rest[:13]), rest[13:28], rest[28:43]
    # the second holds all of the first, at the threshold; what else it has is rarer
    words = [own, np.append(own, others), np.append(own, further), np.append(others, rest[43:58])]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int64()))], names=["w"])
    sets, at = shingle_hashes(np.concatenate(words), np.concatenate(([0], np.cumsum([*map(len, words)]))), 1)
    h1, alike, sids = ngram_join._set_hashes(sets, at)[0], ngram_join._alike(sets, at, ranges), np.arange(4)
    assert alike.tolist() == [1, 1, 1, 0]
    known = pa.RecordBatch.from_arrays([pa.array(x) for x in (h1, sids, np.diff(at), alike, sids)], names=["h1", "sid", "n", "alike", "comp"])

    def by_part(batches):
        return pa.Table.from_batches(list(batches)).sort_by("part").to_batches()

    shared = [*ngram_join._shared(ranges)(by_part(ngram_join._spread(1, ranges)(iter([batch])))), *ngram_join._known(ranges)(iter([known]))]
    out = pa.Table.from_batches(list(ngram_join.grouped(["part"], ngram_join._crossing)(by_part(ngram_join._prefixes(0.5)(by_part(shared))))))
    by = {}
    for token, sid in zip(out["token"].to_pylist(), out["sid"].to_pylist()):
        by.setdefault(sid, set()).add(token)
    assert by[0] & by[1] and by[0] & by[2] and by[1] & by[3]


def test_components_of_paths_stars_and_repeats(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (100, 101), (300, 200)]
    got = dict(cases.tuples(components(spark.createDataFrame(edges, "u long, v long")), "node", "comp"))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_share_of_pairs_at_the_threshold_that_meet_by_no_token():
    rng = np.random.default_rng(7)
    hot, missed, n = np.sort(rng.integers(0, 1 << 63, 1, dtype=np.uint64)), 0, 20_000
    for _ in range(n):
        own = rng.integers(1, 1 << 63, 160, dtype=np.uint64)
        a, b = np.sort(own[:120]), np.sort(own[40:])  # 80 of 160 in common
        missed += not len(np.intersect1d(ngram_join._first(a, hot), ngram_join._first(b, hot)))
    assert missed <= 8


def _shared_runs(words, item, run):
    out = set()
    for i in range(len(words)):
        for j in range(len(item)):
            n = 0
            while i + n < len(words) and j + n < len(item) and words[i + n] == item[j + n]:
                n += 1
            if n >= min(run, len(item)) and not (i and j and words[i - 1] == item[j - 1]):
                out.add((i, n))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"t{rng.randrange(40)}" for _ in range(rng.randrange(3, 40)))) for k in range(8)]
    docs = []
    for d in range(40):
        w = [f"t{rng.randrange(40)}" for _ in range(30)]
        if d % 2:
            own = items[rng.randrange(8)][1].split()
            a = rng.randrange(len(own))
            w[10:10] = own[a : a + rng.randrange(5, 40)]
        docs.append((d, ", ".join(w).upper()))
    got = Counter((r["doc_id"], r["item_id"], r["n_words"]) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = Counter((d, k, n) for d, t in docs for k, x in items for _, n in _shared_runs(t.lower().replace(",", "").split(), x.split(), 13))
    assert got == want


def test_decontamination_of_short_items_and_decomposed_letters(spark):
    items = [(1, "Paris"), (2, "the answer is 42"), (3, "un café naïve sous la pluie de Brême")]
    machine, words = (lambda p: (decontam.automaton(p[0]), p[1]))(decontam.pieces(items))
    text = "So: THE answer is 42; Paris. Un cafe\u0301 nai\u0308ve sous la pluie de Bre\u0302me!"
    found = decontam.scan(text, machine, words)
    assert [(k, text[a:b]) for k, a, b, _ in found] == [(1, "Paris"), (2, "THE answer is 42"), (3, "Un cafe\u0301 nai\u0308ve sous la pluie de Bre\u0302me")]
    docs = spark.createDataFrame([(1, "only Paris here"), (2, text), (3, "nothing")], "doc_id long, text string")
    assert cases.tuples(decontam.drop_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")), "doc_id") == [(1,), (3,)]


def test_decontamination_takes_time_in_proportion_to_the_hits():
    import time

    item = " ".join(f"w{k}" for k in range(40))
    machine, words = (lambda p: (decontam.automaton(p[0]), p[1]))(decontam.pieces([(1, item)]))
    took = []
    for n in (2000, 16000):
        t = time.process_time()
        assert len(decontam.scan((item + " and ") * n, machine, words)) == n
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0]


def test_decontamination_on_odd_tables(spark):
    items = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, ""), (3, "other text of an id"), (3, "other text of an id")], "item_id long, text string")
    assert cases.tuples(decontam.contamination(cases.odd(spark), items), "doc_id", "item_id", "n_words") == [(6, 3, 5)]
    assert decontam.contamination(cases.empty(spark), items).count() == 0 and decontam.contamination(cases.odd(spark), items.limit(0)).count() == 0
    assert decontam.drop_contaminated(cases.odd(spark), items).columns == cases.odd(spark).columns


def test_personal_data_on_held_out_rows():
    field = pii.fit(pii.labelled_rows())
    held = pii.labelled_rows(300, seed=99)
    found = pii.find([t for t, _ in held], field)
    want = {(i, k, a, b) for i, (_, s) in enumerate(held) for a, b, k in s}
    got = {(i, *f) for i, own in enumerate(found) for f in own}
    assert len(want & got) / len(got) > 0.95 and len(want & got) / len(want) > 0.95


def test_stretches_give_the_best_path_of_the_whole():
    """Decoding stretches is decoding the whole text with all other tokens held at O."""
    field = pii.fit(pii.labelled_rows())
    for text, _ in pii.labelled_rows(60, seed=5):
        at = pii.tokens(text)
        if not at:
            continue
        rows = pii.features(text, at, 0, len(at) - 1)
        free = np.zeros(len(at), bool)
        for a, b in pii.stretches(text, at):
            free[a : b + 1] = True
        unary = field.unary(rows)
        unary[~free, 1:] = -1e9
        score, back = field.move[0] + unary[0], []
        for t in range(1, len(at)):
            options = score[:, None] + field.move
            back.append(options.argmax(axis=0))
            score = options.max(axis=0) + unary[t]
        tag = int((score + field.move[:, 0]).argmax())
        path = [tag]
        for p in back[::-1]:
            path.append(int(p[path[-1]]))
        path = path[::-1]
        ours = np.zeros(len(at), int)
        for (a, b), tags in zip(pii.stretches(text, at), field.viterbi([rows[a : b + 1] for a, b in pii.stretches(text, at)])):
            ours[a : b + 1] = tags
        assert ours.tolist() == path


@pytest.mark.parametrize("text, kind, value", [
    ("set password=hunterhunter and go on", "SECRET", "hunterhunter"), ('the api_key: "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTy" here', "SECRET", "QwErTyUiOpAsDfGhJkLzXcVbNmQwErTy"),
    ("call 030/123456 today", "PHONE", "030/123456"), ("secret = 'correcthorse' it was", "SECRET", "correcthorse"),
])
def test_personal_data_without_digits(text, kind, value):
    (found,) = pii.find([text], pii.fit(pii.labelled_rows()))
    assert [(k, text[a:b]) for k, a, b in found] == [(kind, value)]


def test_field_likelihood_and_gradient_against_all_paths(monkeypatch):
    """One step of training moves every weight against the gradient that sums over all tag sequences give."""
    import itertools

    monkeypatch.setattr(pii, "SLOTS", 8)
    rng = np.random.default_rng(1)
    xs = [rng.integers(0, 8, (n, pii.WIDTH)).astype(np.int32) for n in (1, 3, 2)]
    legal = pii._legal()
    ys = [np.array(t) for t in ([1], [0, 3, 4], [5, 0])]

    def loss(emit, move):
        total = 0.0
        for x, y in zip(xs, ys):
            u = emit[x].sum(axis=1)
            path = lambda p: sum(u[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip((0, *p), (*p, 0)))  # noqa: E731, B023
            every = [path(p) for p in itertools.product(range(pii.T), repeat=len(y)) if all(legal[a, b] for a, b in zip((0, *p), (*p, 0)))]
            total += np.log(np.exp(every).sum()) - path(tuple(y))
        return total

    emit, move = np.zeros((8, pii.T)), np.zeros((pii.T, pii.T))
    field = pii.train(xs, ys, passes=1)
    for w, own, at in ((emit, field.emit, [(k, t) for k in range(8) for t in (0, 1, 3, 4, 5)]), (move, field.move, [(0, 1), (1, 0), (0, 3), (3, 4), (4, 0), (5, 0)])):
        for k in at:
            w[k] = 1e-5
            up = loss(emit, move)
            w[k] = -1e-5
            slope, w[k] = (up - loss(emit, move)) / 2e-5, 0
            # the first step of Adam is the sign of the gradient
            if abs(slope) > 1e-4:
                assert np.sign(own[k]) == -np.sign(slope)
                assert abs(abs(own[k]) - 0.25 / 3) < 1e-4


def test_personal_data_on_odd_tables(spark):
    df = cases.odd(spark, [(8, "write to jane.doe@mail.example.com now", "en", "s"), (8, "write to jane.doe@mail.example.com now", "en", "s")])
    got = cases.tuples(pii.personal_data(df, pii.labelled_table(spark)), "doc_id", "kind", "start_char", "end_char")
    assert got.count((8, "EMAIL", 9, 34)) == 2 and (None, "EMAIL", 21, 29) in got
    assert pii.personal_data(cases.empty(spark)).count() == 0
    assert pii.personal_data(df, pii.labelled_table(spark).limit(0)).count() == 0


def test_patience_alignment():
    a, b = "x the cat sat on the mat y".split(), "the cat lay on the mat".split()
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == 5
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.patience([], b) == [] and licenses.patience(["a", "a"], ["b"]) == []
    rng = random.Random(2)
    for _ in range(100):
        pairs = [(p, k) for k, p in enumerate(rng.sample(range(30), 12))]
        best = [1] * 12
        for k in range(12):
            best[k] = 1 + max([best[j] for j in range(k) if pairs[j][0] < pairs[k][0]], default=0)
        assert len(licenses._longest_increasing(pairs)) == max(best)


def test_license_scan_misses_nothing_that_aligning_everywhere_finds():
    rng = random.Random(4)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for _, template in licenses.TEMPLATES:
        words = template.split()
        for k in rng.sample(range(len(words)), len(words) // 12):
            words[k] = "changed"
        text = " ".join(["lorem"] * 20 + words + ["ipsum"] * 20)
        pairs = licenses.patience(licenses.words_of(text)[0], licenses.words_of(template)[0])
        found = scanner.scan(text)
        assert found and max(f[2] for f in found) >= len(pairs)


@pytest.mark.parametrize("text, names", [
    ("Foo version 1.3. {}", 1), ("apache apache version {}", 1), ("{} Version 3 of apache", 1), ("version {} version apache", 1),
    ("{} {} version {}", 3), ("apache. {} Foo version 1.3. {}", 2),
])
def test_stray_key_words_do_not_cut_a_license(text, names):
    scanner, own = licenses.Scanner(licenses.TEMPLATES), "Licensed under the Apache License, Version 2.0."
    parts = text.split("{}")
    want, at = [], 0
    for part in parts[:-1]:
        at += len(part)
        want.append(("Apache-2.0", 1.0, at, at + len(own) - 1))
        at += len(own)
    assert len(want) == names and [(f[0], f[1], f[4], f[5]) for f in scanner.scan(text.replace("{}", own))] == want
    assert [f[:2] for f in scanner.scan("version Licensed under the Apache version License, Version 2.0.")] == [("Apache-2.0", 1.0)]


def test_license_scan_finds_what_some_window_of_aligned_ends_covers():
    rng = random.Random(8)
    template = "alpha beta gamma of the delta beta epsilon of zeta".split()
    scanner, n, some = licenses.Scanner([("T", " ".join(template))]), len(template), 0
    for _ in range(150):
        own = [rng.choice(template + ["x", "y"]) for _ in range(8)] + template + [rng.choice(template + ["x", "y"]) for _ in range(8)]
        for _ in range(rng.randrange(4)):
            own[rng.randrange(8, 18)] = rng.choice(template + ["x"])
        best = 0
        for a in range(len(own)):
            for b in range(a + 8, min(len(own), a + 2 * n) + 1):
                pairs = licenses.Scanner._compact(licenses.patience(own[a:b], template))
                if len(pairs) >= 8 and pairs[0][0] == 0 and pairs[-1][0] == b - a - 1:
                    best = max(best, len(pairs))
        found = scanner.scan(" ".join(own))
        assert bool(found) == bool(best)
        some += bool(best)
    assert 30 < some


def test_license_scan_takes_time_in_proportion_to_the_licenses():
    import time

    scanner, took = licenses.Scanner(licenses.TEMPLATES), []
    for n in (500, 4000):
        t = time.process_time()
        assert len(scanner.scan("Released under the MIT License. Some words go here then. " * n)) == n
        took.append(time.process_time() - t)
    assert took[1] < 20 * took[0]


def test_each_template_is_found_in_itself():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        assert name in {f[0] for f in scanner.scan(f"Before it. {text} Behind it.")}


def test_patience_anchors_and_gaps_against_their_definition():
    """Each aligned pair is part of a common beginning or end of a gap, or a word that is unique on both sides of it."""
    rng = random.Random(3)

    def align(a, b, i, j):
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        a, b, out = a[head:], b[head:], [(i + k, j + k) for k in range(head)]
        i, j, tail = i + head, j + head, 0
        while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        out += [(i + len(a) - 1 - k, j + len(b) - 1 - k) for k in range(tail)]
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        pairs = [(a.index(w), k) for k, w in enumerate(b) if a.count(w) == 1 and b.count(w) == 1]
        if not pairs:
            return out
        best = [1] * len(pairs)
        for k in range(len(pairs)):
            best[k] = 1 + max([best[m] for m in range(k) if pairs[m][0] < pairs[k][0]], default=0)
        kept = set(licenses._longest_increasing(pairs))
        assert len(kept) == max(best) and kept <= set(pairs)
        x = y = 0
        for p, q in [*sorted(kept), (len(a), len(b))]:
            out += align(a[x:p], b[y:q], i + x, j + y)
            out += [(i + p, j + q)] if p < len(a) else []
            x, y = p + 1, q + 1
        return out

    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randrange(14))] for _ in range(2))
        assert licenses.patience(a, b) == sorted(align(a, b, 0, 0))


def test_licenses_on_odd_tables(spark):
    text = "Lorem ipsum.\nReleased under the MIT License.\nDolor. Released under the MIT License."
    got = cases.tuples(licenses.license_scan(cases.odd(spark, [(8, text, "en", "s"), (9, "no license at all here", "en", "s")])), "doc_id", "license", "coverage", "start_char", "end_char")
    assert got == [(8, "MIT", 1.0, 13, 43), (8, "MIT", 1.0, 52, 82)]
    assert licenses.license_scan(cases.empty(spark)).count() == 0 and licenses.license_scan(cases.odd(spark), []).count() == 0


def test_words_hashed_in_arrays_are_those_of_the_pattern(spark, monkeypatch):
    """Lengths about the hash's strides of 32, 8 and 4 bytes, letters of one to four bytes, texts that touch, and context in lower case."""
    import pyarrow as pa

    texts = [None, "", "one", "two", ".", "x1 " + " ".join(c * k for k in range(1, 70) for c in "aé")]
    texts += ["ΟΔΟΣ ΑΣ. ΑΣΑ Σ", "İstanbul ẞ ǅ Ⅷ½ straße", "😀𝔘𐐀 中文、字 \0 nul", "end", "and more"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    want = [r[0] or [] for r in rows.orderBy("k").select(word_hashes(rows["t"])).collect()]
    for at_once in (1, 40, 1 << 18):
        monkeypatch.setattr("chunkwise.llm.common.AT_ONCE", at_once)
        words, at = hashed_words(pa.array(texts))
        assert [words[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_join_reads_the_texts_once_before_its_second_step(spark, monkeypatch):
    """Frequent tokens are counted over what the first pass has written, not over texts that are hashed again."""
    seen = []
    monkeypatch.setattr(ngram_join, "_frequent", lambda met, *rest, own=ngram_join._frequent: seen.append(met) or own(met, *rest))
    ngram_join.jaccard_classes(cases.odd(spark))
    assert [any("/cut-" in f for f in df.inputFiles()) for df in seen] == [True]
