"""Quality classifier by co-training: one classifier reads the words, the other what is known about the page.

Both start from a bounded sample of labelled rows. In each round either view scores all documents whose labels aren't used, over
the cluster, and the other view learns from those of which it is surest. The calibrated views are then combined and score all documents.
A good document is one of good quality that isn't toxic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, flat, small_batches, table, word_array

#: Labelled rows that the classifier is fitted on, at most.
LABELLED = 6000
ROUNDS, EXCHANGED, SURE, SEED = 3, 300, 0.97, 11
WORD_BITS, META_BITS = 20, 14
STEM = 5
#: Features with a log-count ratio below this tell nothing and are left out.
FAINT = 0.4
#: Feature entries that are worked on together in a fit; bounds its memory, not what it sees.
AT_ONCE = 1 << 19


def _word_features(text: Column) -> Column:
    """Hashed words, word beginnings and runs of marks."""
    word = word_array(text)
    marks = F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}\s]{2,}"), F.lit(0))
    words = F.flatten(F.transform(word, lambda w: F.array(F.xxhash64(w), F.xxhash64(F.substring(w, 1, STEM), F.lit(1)))))
    return F.concat(words, F.transform(marks, lambda m: F.xxhash64(m, F.lit(2))))


_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 1 if "A" <= _s <= "Z" else 2 if "a" <= _s <= "z" else 3 if "0" <= _s <= "9" else 4 if _s in " \t" else 5 if _s == "\n" else 6 if _s in ".,;:'\"?-()" else 7 if _s == "!" else 8 if _s == "|" else 9 if _c >= 128 else 11 + "%$&*#<>/\\_@=+".find(_s) if _s in "%$&*#<>/\\_@=+" else 10
KINDS = int(_CLASS.max()) + 1
_EDGES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])


def _meta_features(lang: pa.Array, source: pa.Array, text: pa.Array) -> np.ndarray:
    """A row of feature numbers for each page: language, source, size, lines, line length, shares of kinds of characters."""
    n = len(text)
    raw = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    size = np.diff(at)
    counts = np.zeros(n * KINDS, np.int64)
    for x in range(0, len(data), AT_ONCE):
        which = np.repeat(np.arange(n), np.diff(np.clip(at, x, x + AT_ONCE)))
        counts += np.bincount(which * KINDS + _CLASS[data[x : x + AT_ONCE]], minlength=n * KINDS)
    counts = counts.reshape(n, KINDS)
    share = np.digitize(counts / np.maximum(size, 1)[:, None], _EDGES)
    own = [np.log2(size + 1).astype(int), np.log2(counts[:, 5] + 1).astype(int), np.log2(size / (counts[:, 5] + 1) + 1).astype(int)]
    names = [np.array([hash_name(x) for x in column.to_pylist()]) for column in (lang, source)]
    columns = [*names, *own, *(share[:, k] for k in range(1, KINDS))]
    slots = [np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) + np.asarray(c).astype(np.int64).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) for k, c in enumerate(columns)]
    return (np.stack(slots, axis=1) >> np.uint64(64 - META_BITS)).astype(np.int64)


def hash_name(name: str | None) -> int:
    out = 7
    for ch in name or "\0":
        out = (out * 131 + ord(ch)) % (1 << 40)
    return out


def _slots(words: np.ndarray) -> np.ndarray:
    return (words.view(np.uint64) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


FEATURES = "doc_id long, key long, words binary, meta binary, n int"
_SIDES, _LOW = 1 << WORD_BITS - 16, (1 << 16) - 1


def _packed(slots: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The distinct slots of each row: how many have each high part, then the low parts in order, two bytes each."""
    n = len(at) - 1
    own = np.unique(np.repeat(np.arange(n), np.diff(at)) << WORD_BITS | slots)
    counts = np.bincount(own >> 16, minlength=n * _SIDES).astype(np.uint32).reshape(n, _SIDES)
    low, ends = (own & _LOW).astype(np.uint16), np.concatenate(([0], np.cumsum(counts.sum(axis=1, dtype=np.int64))))
    return [counts[i].tobytes() + low[ends[i] : ends[i + 1]].tobytes() for i in range(n)]


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as 16-bit numbers, and where each row begins."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint16), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint16, (offsets[-1] - offsets[0]) // 2, int(offsets[0])) if offsets[-1] > offsets[0] else np.zeros(0, np.uint16)
    return data, (offsets - offsets[0]) // 2


def _unpacked(column) -> tuple[np.ndarray, np.ndarray]:
    """Slots and offsets of what _packed() wrote."""
    data, at = _bytes_of(column)
    n = len(at) - 1
    head = (at[:-1, None] + np.arange(2 * _SIDES)).ravel()
    counts = data[head].view(np.uint32).reshape(n, _SIDES).astype(np.int64)
    low = np.ones(len(data), bool)
    low[head] = False
    slots = data[low].astype(np.int32)
    slots |= np.repeat(np.tile(np.arange(_SIDES, dtype=np.int32) << 16, n), counts.ravel())
    return slots, np.concatenate(([0], np.cumsum(counts.sum(axis=1))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: those to keep, then words, lang, source, text."""
    for batch in batches:
        words, at = flat(batch.columns[-4])
        own = _packed(_slots(words) if len(words) else np.zeros(0, np.int64), at)
        meta = [m.tobytes() for m in _meta_features(*batch.columns[-3:]).astype(np.uint16)]
        kept = batch.columns[:-4]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.binary()), pa.array(meta, pa.binary()), pa.array(np.diff(at).astype(np.int32) // 2)], names=[*batch.schema.names[: len(kept)], "words", "meta", "n"])


@dataclass
class View:
    """A logistic model over sparse features, with Platt's calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * raw + self.shift, -30, 30)


@dataclass
class Sparse:
    """Rows of feature numbers laid end to end; scale weighs a row's features."""

    slots: np.ndarray
    at: np.ndarray
    scale: np.ndarray

    def take(self, rows: np.ndarray) -> Sparse:
        parts = [self.slots[self.at[i] : self.at[i + 1]] for i in rows]
        return Sparse(np.concatenate(parts) if parts else self.slots[:0], np.concatenate(([0], np.cumsum(np.diff(self.at)[rows]))), self.scale[rows])

    def portions(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, row within these of each entry, entries), about AT_ONCE entries at a time."""
        cuts = np.unique(np.concatenate(([0], np.searchsorted(self.at, np.arange(AT_ONCE, int(self.at[-1]), AT_ONCE)), [len(self.scale)])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield a, b, np.repeat(np.arange(b - a, dtype=np.int32), np.diff(self.at[a : b + 1])), self.slots[self.at[a] : self.at[b]]

    def raw(self, view: View) -> np.ndarray:
        out = np.zeros(len(self.scale))
        for a, b, rows, slots in self.portions():
            w = view.weights[slots]
            used = np.flatnonzero(w)
            out[a:b] = np.bincount(rows[used], w[used], minlength=b - a)
        return out * self.scale + view.bias


def _joined(parts: list[Sparse]) -> Sparse:
    shifts = np.cumsum([0, *(int(p.at[-1]) for p in parts)])
    return Sparse(np.concatenate([p.slots for p in parts]), np.concatenate([[0], *(p.at[1:] + k for p, k in zip(parts, shifts))]), np.concatenate([p.scale for p in parts]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(data: Sparse, y: np.ndarray, size: int, least: int, steps: int = 80) -> View:
    """Full-batch Adam with L2 on features weighted by their log-count ratio; those of fewer than `least` rows are left out.

    Without rows the view is the prior of even odds.
    """
    good, seen = np.zeros(size), np.zeros(size, np.int64)
    for a, b, rows, slots in data.portions():
        good += np.bincount(slots, y[a:b][rows], minlength=size)
        seen += np.bincount(slots, minlength=size)
    ratio = (np.log((good + 1) / (y.sum() + 2)) - np.log((seen - good + 1) / ((1 - y).sum() + 2))).astype(np.float32)
    ratio[(seen < least) | (np.abs(ratio) < FAINT)] = 0
    kept = np.flatnonzero(ratio)
    column = np.full(size, -1, np.int32)
    column[kept] = np.arange(len(kept))
    parts = []
    for a, b, rows, slots in data.portions():
        used = np.flatnonzero(column[slots] >= 0)
        rows, slots = rows[used], slots[used]
        parts.append((a, b, rows, column[slots], ratio[slots] * data.scale[a:b][rows].astype(np.float32)))
    w, b0 = np.zeros(len(kept)), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    m, v, bm, bv = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    mean = y.mean() if len(y) else 0.5
    balance = np.where(y > 0, 0.5 / max(mean, 1e-6), 0.5 / max(1 - mean, 1e-6)) / max(len(y), 1)
    d = np.zeros(len(y))
    for t in range(1, steps + 1):
        g = 1e-5 * w
        for a, b, rows, columns, value in parts:
            z = np.bincount(rows, w[columns] * value, minlength=b - a) + b0
            d[a:b] = (_sigmoid(z) - y[a:b]) * balance[a:b]
            g += np.bincount(columns, d[a:b][rows] * value, minlength=len(kept))
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        bm, bv = 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
        step = 0.3 / (1 + 3 * t / steps)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b0 -= step * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[kept] = w * ratio[kept]
    return View(weights, float(b0))


def _calibrate(view: View, raw: np.ndarray, y: np.ndarray) -> None:
    """Platt's slope and shift by Newton's method on rows that the view hasn't seen."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = _sigmoid(a * raw + b)
        g = np.array([((p - target) * raw).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * raw * raw).sum() + 1e-3, (h * raw).sum()], [(h * raw).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    view.slope, view.shift = max(a, 0.0), b


def _scale(n: np.ndarray) -> np.ndarray:
    """Features of a text weigh less the more words it has; a few words alone say little."""
    return 1 / np.sqrt(n + 30.0)


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def score(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Both calibrated views, as if independent given the class; the prior counts once."""
        return _sigmoid(t + m - self.prior)


#: Of each view: how many features there are, and in how many rows one has to occur.
VIEWS = ((1 << WORD_BITS, 4), (1 << META_BITS, 3))


def _rows(columns: list) -> tuple[Sparse, Sparse]:
    """Both views of rows with the columns words, meta and n."""
    slots, at = _unpacked(columns[0])
    meta, begin = _bytes_of(columns[1])
    n = np.asarray(columns[2])
    return Sparse(slots, at, _scale(n)), Sparse(meta.astype(np.int32), begin, np.ones(len(n)))


def co_train(labelled: pa.Table, surest: Callable, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> Model:
    """Fit both views on a table of (good, words, meta, n).

    surest(views, taken, wanted) gives, for each view, rows (key, label, words, meta, n) of the unlabelled documents of which it is
    surest: wanted[label] of each label at most, without the keys taken[view].
    """
    known, y_known = _rows([labelled[c] for c in ("words", "meta", "n")]), labelled["good"].to_numpy().astype(float)
    held = np.arange(len(y_known)) % 5 == 0
    own, tested = [x.take(np.flatnonzero(~held)) for x in known], [x.take(np.flatnonzero(held)) for x in known]
    del known, labelled
    prior = float(np.log((y_known.sum() + 1) / ((1 - y_known).sum() + 1)))
    extra: list[list[tuple[np.ndarray, np.ndarray, Sparse]]] = [[], []]
    views: list[View] = []
    for turn in range(rounds + 1):
        views = []
        for k, (size, least) in enumerate(VIEWS):
            y = np.concatenate([y_known[~held], *(label for _, label, _ in extra[k])])
            view = _fit(_joined([own[k], *(rows for _, _, rows in extra[k])]), y, size, least)
            _calibrate(view, tested[k].raw(view), y_known[held])
            views.append(view)
        if turn == rounds or not len(y_known):
            break
        share = y_known.mean()
        wanted = {1: int(exchanged * share), 0: int(exchanged * (1 - share))}
        taken = [np.concatenate([np.zeros(0, np.int64), *(key for key, _, _ in extra[1 - k])]) for k in (0, 1)]
        for k, t in enumerate(surest(views, taken, wanted)):
            if t.num_rows:
                extra[1 - k].append((t["key"].to_numpy(), t["label"].to_numpy().astype(float), _rows([t[c] for c in ("words", "meta", "n")])[1 - k]))
    return Model(views[0], views[1], prior)


def _view_scores(text: View, meta: View, columns: list) -> tuple[np.ndarray, np.ndarray]:
    """Calibrated log-odds of both views, of the columns words, meta and n."""
    own, about = _rows(columns)
    return text.logit(own.raw(text)), meta.logit(about.raw(meta))


def _candidates(sent) -> Callable:
    """Of each task and view, the wanted number of distinct documents of each label of which it is surest."""
    least = float(np.log(SURE / (1 - SURE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taken, wanted = sent.value
        kept = {(k, label): (np.zeros(0), np.zeros(0, np.int64)) for k in (0, 1) for label in wanted}
        for batch in batches:
            if not batch.num_rows:
                continue
            key, scores = batch.column(0).to_numpy(), _view_scores(*views, batch.columns[-3:])
            free = [~np.isin(key, taken[k]) for k in (0, 1)]
            for (k, label), (best, keys) in kept.items():
                sure = scores[k] if label else -scores[k]
                good = free[k] & (sure >= least)
                keys, first = np.unique(np.concatenate((keys, key[good])), return_index=True)
                best = np.concatenate((best, sure[good]))[first]
                order = np.lexsort((keys, -best))[: wanted[label]]
                kept[k, label] = best[order], keys[order]
        for (k, label), (best, keys) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), label, np.int32)), pa.array(best), pa.array(keys)], names=["view", "label", "sure", "key"])

    return run


def _surest(pool: DataFrame) -> Callable:
    """Choose from all of a table of features, as co_train() wants it. Only the chosen rows come to the driver."""

    def choose(views: list[View], taken: list[np.ndarray], wanted: dict[int, int]) -> list[pa.Table]:
        sent = pool.sparkSession.sparkContext.broadcast((views, taken, wanted))
        found = pool.select("key", "words", "meta", "n").mapInArrow(_candidates(sent), "view int, label int, sure double, key long").distinct()
        place = F.row_number().over(Window.partitionBy("view", "label").orderBy(F.desc("sure"), "key"))
        limit = F.when(F.col("label") == 1, wanted[1]).otherwise(wanted[0])
        best = found.withColumn("place", place).where(F.col("place") <= limit).select("view", "label", "key").collect()
        sent.unpersist()
        chosen = pool.sparkSession.createDataFrame([(x,) for x in sorted({r["key"] for r in best})], "key long")
        rows = pool.select("key", "words", "meta", "n").join(F.broadcast(chosen), "key").dropDuplicates(["key"]).toArrow()
        place_of = {key: i for i, key in enumerate(rows["key"].to_pylist())}
        out = []
        for k in (0, 1):
            own = sorted((r["label"], r["key"]) for r in best if r["view"] == k)
            out.append(rows.take(pa.array([place_of[key] for _, key in own], pa.int64())).append_column("label", pa.array([label for label, _ in own], pa.int32())))
        return out

    return choose


def _feature_table(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The features of all rows, written once, with all columns of docs if `whole`.

    Rows alike in id and content have the same key; other rows of an id are documents of their own.
    """
    small_batches(docs.sparkSession)
    known = [F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "lang", "source"))]
    key = F.xxhash64(F.lit(SEED), *(F.coalesce(c.cast("string"), F.lit("\0")) for c in known)).alias("key")
    packed = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept, schema = ([packed], f"row {docs.schema.simpleString()}, ") if whole else ([], "")
    read = docs.select(*kept, known[0].alias("doc_id"), key, _word_features(known[1]).alias("w"), known[2].alias("lang"), known[3].alias("source"), known[1].alias("text"))
    return cut(read.mapInArrow(_features, schema + FEATURES))


def fit(features: DataFrame, labels: DataFrame, max_labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Co-train on at most max_labelled labels, chosen by a seeded hash of the id, and on all documents that have none of these."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("__q"), F.max(F.coalesce("toxic", F.lit(0))).alias("__t"))
    sample = marks.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(max_labelled).select("doc_id", F.expr("cast(__q = 1 and __t = 0 as int)").alias("good"))
    rows = [(r["doc_id"], r["good"]) for r in sample.collect()]  # bounded by the parameter
    chosen = F.broadcast(features.sparkSession.createDataFrame(rows, "doc_id long, good int"))
    labelled = features.select("doc_id", "key", "words", "meta", "n").join(chosen, "doc_id").toArrow()
    order = np.lexsort((labelled["key"].to_numpy(), labelled["doc_id"].to_numpy()))
    return co_train(labelled.take(pa.array(order)), _surest(features.join(chosen, "doc_id", "left_anti")), rounds)


def _scorer(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            t, m = _view_scores(model.text, model.meta, batch.columns[-3:])
            s = model.score(t, m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(t)), pa.array(_sigmoid(m)), pa.array(s), pa.array(s >= 0.5)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    return run


def _keeper(sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            keep = model.score(*_view_scores(model.text, model.meta, batch.columns[-3:])) >= 0.5
            yield batch.select([0]).filter(pa.array(keep))

    return run


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) of every row of docs; keep is score >= 0.5.

    A null or empty text has no words and is judged by its metadata; null languages and sources are values of
    their own. Labels with null ids or qualities are left out, a null toxic counts as 0, and of contradicting labels the
    worse holds. Rows that repeat an id are scored one by one. Without labels every score is the prior, 0.5. If all documents have labels that
    are used, there is nothing to exchange and the views learn from the labels alone. An empty table gives no rows. Ids have to be
    integers; other columns are ignored.
    """
    features = _feature_table(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(features, labels, **bounds))
    return features.select("doc_id", "words", "meta", "n").mapInArrow(_scorer(sent), "doc_id long, p_text double, p_meta double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns; nulls, repeats and empty tables are as in score().

    The rows are written once beside their features, so that no text is read or moved a second time.
    """
    features = _feature_table(docs, whole=True)
    sent = docs.sparkSession.sparkContext.broadcast(fit(features, labels, **bounds))
    kept = features.select("row", "words", "meta", "n").mapInArrow(_keeper(sent), f"row {docs.schema.simpleString()}")
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), table(spark, sf_dir, "labels"))
