"""Language-model scores from a subword lattice: a text's probability summed over all its segmentations.

The vocabulary and the order of its scores exist already; nothing here trains a tokenizer. A word is segmented by itself,
so a text's marginal probability is the product of its words'. Each distinct word's lattice is run once, by a forward
recursion in log space, many words in lockstep. A second set of scores is fitted to the corpus: expected piece counts
over all segmentations of every word of every document, with the existing scores as the prior.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: The file that the query reads; operators are told theirs.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Probability of all single bytes together; they spell characters that the vocabulary lacks.
BYTE_MASS = 1e-4
#: Counts that the existing scores stand for, against those gathered from the corpus.
PRIOR = 100_000.0
#: Distinct words that a worker remembers or counts before it starts afresh or hands them on; bounds memory only.
REMEMBERED = 1 << 19
#: Cells of a lattice that are computed together; bounds memory only, and keeps them near the processor.
CELLS = 1 << 17
#: Words whose lattices are run together, so that there are many of each length.
AT_ONCE = 1 << 16
#: Bits of the table in which pieces are looked up.
SLOT_BITS = 20
#: A word of so many characters is run by itself, WINDOW of them at a time.
LONG, WINDOW = 2048, 1 << 14
MARK, NONE = "▁", -1e30
_P, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of one string's code points, as the lattice builds it up character by character."""
    h = np.zeros(1, np.uint64)
    for c in codes.astype(np.uint64):
        h = (h + c + np.uint64(1)) * _P
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Vocabulary:
    """Pieces with log probabilities, laid out for lookups of many substrings at once."""

    def __init__(self, pieces: list[str], logp: np.ndarray, byte_logp: np.ndarray):
        keys = np.concatenate([_hashes(_codes(p)) for p in pieces]) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.pieces, self.logp, self.byte_logp = pieces, np.asarray(logp, float), np.asarray(byte_logp, float)
        self.longest = max((len(p) for p in pieces), default=1)
        # of most slots there's one key; where there are more, they are searched for
        slots = ((self.keys * _SPREAD) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot = np.full(1 << SLOT_BITS, len(self.keys), np.int32)
        self.slot[slots] = np.arange(len(self.keys))
        shared = np.bincount(slots, minlength=1 << SLOT_BITS) > 1
        self.slot[shared] = -1
        self.padded = np.append(self.keys, np.uint64(0))
        self.named = np.append(self.ids, np.int32(-1))

    def with_scores(self, logp: np.ndarray, byte_logp: np.ndarray) -> Vocabulary:
        out = object.__new__(Vocabulary)
        out.__dict__ = self.__dict__ | {"logp": logp, "byte_logp": byte_logp}
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -1 for none."""
        at = self.slot[(h * _SPREAD) >> np.uint64(64 - SLOT_BITS)]
        several = np.flatnonzero(at < 0)
        if len(several):
            k = np.minimum(np.searchsorted(self.keys, h[several]), len(self.keys) - 1)
            at[several] = k
        out = self.named[at]
        out[self.padded[at] != h] = -1
        return out


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece file and their scores.

    Scores of a unigram model are log probabilities and taken as such. Those of a BPE model count its merges down from 0;
    as merges come in the order of frequency, the r-th piece weighs 1 / (r + 2). Pieces that hold a blank anywhere but in front
    can't occur within a word and are left out, and so are control symbols.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = [i for i in ids if model.id_to_piece(i) and MARK not in model.id_to_piece(i)[1:]]
    scores = np.array([model.get_score(i) for i in ids], float)
    ranks = bool(len(scores)) and bool((scores == np.round(scores)).all())
    logp = -np.log(2 - scores) if ranks else scores
    logp = logp - np.log(np.exp(logp).sum()) + np.log1p(-BYTE_MASS)
    return Vocabulary([model.id_to_piece(i) for i in ids], logp, np.full(256, np.log(BYTE_MASS / 256)))


class _Lattice:
    """Edges of words of one length, which includes the mark: ids[k][start, n] is the piece of k + 1 characters, score its log probability."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary, self.n, self.length = vocabulary, len(words), len(words[0]) + 1
        self.letters = np.ascontiguousarray(_codes("".join(MARK + w for w in words)).reshape(self.n, self.length).T)
        codes, h = self.letters.astype(np.uint64) + np.uint64(1), np.zeros((self.length, self.n), np.uint64)
        self.ids = []
        for k in range(min(vocabulary.longest, self.length)):
            h = (h[: self.length - k] + codes[k:]) * _P
            self.ids.append(vocabulary.find(h.ravel()).reshape(h.shape))
        self.spelled = np.nonzero(self.ids[0] < 0)
        self.scores(vocabulary)

    def scores(self, vocabulary: Vocabulary) -> None:
        logp = np.append(vocabulary.logp, NONE)  # at -1
        self.score = [logp[i] for i in self.ids]
        if len(self.spelled[0]):
            own, which = np.unique(self.letters[self.spelled], return_inverse=True)
            worth = np.array([vocabulary.byte_logp[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in own])
            self.score[0][self.spelled] = worth[which]

    def forward(self) -> np.ndarray:
        """alpha[t, n]: log probability of the first t characters."""
        alpha = np.zeros((self.length + 1, self.n))
        x = np.empty((len(self.score), self.n))
        for t in range(1, self.length + 1):
            some = min(len(self.score), t)
            for k in range(some):
                np.add(alpha[t - 1 - k], self.score[k][t - 1 - k], out=x[k])
            alpha[t] = _log_sum(x[:some])
        return alpha

    def backward(self) -> np.ndarray:
        """beta[t, n]: log probability of the characters from t on."""
        beta = np.zeros((self.length + 1, self.n))
        x = np.empty((len(self.score), self.n))
        for t in range(self.length - 1, -1, -1):
            some = min(len(self.score), self.length - t)
            for k in range(some):
                np.add(beta[t + 1 + k], self.score[k][t], out=x[k])
            beta[t] = _log_sum(x[:some])
        return beta

    def counts(self, n: np.ndarray, out: np.ndarray) -> None:
        """Add the expected uses of pieces, and of bytes behind them, if the words occur n times."""
        alpha, beta = self.forward(), self.backward()
        for k, (ids, score) in enumerate(zip(self.ids, self.score)):
            start, which = np.nonzero(score > NONE / 2)
            share = np.exp(alpha[start, which] + score[start, which] + beta[start + k + 1, which] - alpha[-1, which]) * n[which]
            _tally(out, ids[start, which], share, self.letters[start, which], len(self.vocabulary.pieces))


def _log_sum(x: np.ndarray) -> np.ndarray:
    if len(x) == 1:
        return x[0]
    top = x.max(axis=0)
    y = x - top
    np.exp(y, out=y)
    return top + np.log(y.sum(axis=0))


class _Long:
    """The lattice of one long word, of which a window of edges is held at a time; memory beyond that is two numbers for each character."""

    def __init__(self, vocabulary: Vocabulary, word: str):
        self.vocabulary, self.codes = vocabulary, _codes(MARK + word)

    def edges(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces that begin within a window: start, end and id, -1 where a character is spelled in bytes; by start."""
        n, k = len(self.codes), self.vocabulary.longest
        size = min(WINDOW, n - at)
        codes = np.zeros(size + k, np.uint64)
        codes[: min(size + k, n - at)] = self.codes[at : at + size + k]
        h, ids = np.zeros(size, np.uint64), np.full((size, k), -1, np.int32)
        for j in range(k):
            h = (h + codes[j : j + size] + np.uint64(1)) * _P
            fits = np.flatnonzero(np.arange(at, at + size) + j < n)
            ids[fits, j] = self.vocabulary.find(h[fits])
        used = ids >= 0
        used[:, 0] = True
        start, j = np.nonzero(used)
        return start + at, start + at + j + 1, ids[start, j]

    def weights(self, vocabulary: Vocabulary, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = vocabulary.logp[ids] if len(vocabulary.logp) else np.zeros(len(ids))
        spelled = np.flatnonzero(ids < 0)
        own, which = np.unique(self.codes[start[spelled]], return_inverse=True)
        out[spelled] = np.array([vocabulary.byte_logp[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in own])[which] if len(own) else 0
        return out

    def forward(self, vocabulary: Vocabulary) -> array:
        """alpha[t]: log probability of the first t characters."""
        alpha = array("d", [NONE]) * (len(self.codes) + 1)
        alpha[0] = 0.0
        for at in range(0, len(self.codes), WINDOW):
            start, end, ids = self.edges(at)
            for a, b, w in zip(start.tolist(), end.tolist(), self.weights(vocabulary, start, ids).tolist()):
                x, y = alpha[a] + w, alpha[b]
                alpha[b] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
        return alpha

    def counts(self, n: float, out: np.ndarray) -> None:
        """Add the expected uses of pieces, and of bytes behind them, if the word occurs n times."""
        alpha, size = np.array(self.forward(self.vocabulary)), len(self.codes)
        beta = array("d", [NONE]) * (size + 1)
        beta[size] = 0.0
        for at in range((size - 1) // WINDOW * WINDOW, -1, -WINDOW):
            start, end, ids = self.edges(at)
            worth = self.weights(self.vocabulary, start, ids)
            for a, b, w in zip(start[::-1].tolist(), end[::-1].tolist(), worth[::-1].tolist()):
                x, y = beta[b] + w, beta[a]
                beta[a] = max(x, y) + math.log1p(math.exp(-abs(x - y)))
            share = np.exp(alpha[start] + worth + np.frombuffer(beta)[end] - alpha[size]) * n
            _tally(out, ids, share, self.codes[start], len(self.vocabulary.pieces))


def _tally(out: np.ndarray, ids: np.ndarray, share: np.ndarray, letters: np.ndarray, pieces: int) -> None:
    """Add shares to pieces, or to the bytes of letters without one."""
    out[:pieces] += np.bincount(ids[ids >= 0], share[ids >= 0], minlength=pieces)
    own, which = np.unique(letters[ids < 0], return_inverse=True)
    for c, v in zip(own, np.bincount(which, share[ids < 0]) if len(own) else ()):
        for b in chr(c).encode("utf-8", "surrogatepass"):
            out[pieces + b] += v


def _portions(words: list[str]) -> Iterator[list[int]]:
    """Indices of words of one length, a bounded number of cells at a time; long words come alone."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if words else ():
        n = int(lengths[some[0]]) + 1
        size = max(1, CELLS // (n * min(n, 16))) if n <= LONG else 1
        for at in range(0, len(some), size):
            yield some[at : at + size].tolist()


def word_scores(words: list[str], *vocabularies: Vocabulary) -> np.ndarray:
    """A row of log marginals for each of the vocabularies, which differ in their scores alone."""
    out = np.zeros((len(vocabularies), len(words)))
    for some in _portions(words):
        if len(words[some[0]]) >= LONG:
            lattice = _Long(vocabularies[0], words[some[0]])
            out[:, some[0]] = [lattice.forward(v)[-1] for v in vocabularies]
            continue
        lattice = _Lattice(vocabularies[0], [words[i] for i in some])
        for k, vocabulary in enumerate(vocabularies):
            if k:
                lattice.scores(vocabulary)
            out[k, some] = lattice.forward()[-1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Expected uses of each piece, then of each byte, over all segmentations of the words."""
    out = np.zeros(len(vocabulary.pieces) + 256)
    for some in _portions(words):
        if len(words[some[0]]) >= LONG:
            _Long(vocabulary, words[some[0]]).counts(float(counts[some[0]]), out)
        else:
            _Lattice(vocabulary, [words[i] for i in some]).counts(counts[some], out)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(text.split())
        if len(seen) > REMEMBERED:
            yield emit()
            seen = Counter()
    if seen:
        yield emit()


def _expecter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words, counts = np.zeros(len(sent.value.pieces) + 256), [], []

        def add() -> None:
            total[:] += expected_counts(words, np.array(counts, float), sent.value)
            words.clear(), counts.clear()

        for batch in batches:
            words += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            if len(words) >= AT_ONCE or sum(map(len, words[-batch.num_rows :])) > LONG * AT_ONCE:
                add()
        add()
        if total.any():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "uses"])

    return run


def fit_scores(docs: DataFrame, vocabulary: Vocabulary, prior: float = PRIOR) -> Vocabulary:
    """The vocabulary with scores fitted to every word of docs: one round of expectation and maximisation from the existing scores.

    What comes to the driver is a number for each piece. Word counts are what is shuffled, and grow with the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    words = docs.select("text").where("text is not null").mapInArrow(_count_words, "word string, n long")
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    sent = spark.sparkContext.broadcast(vocabulary)
    uses = counts.mapInArrow(_expecter(sent), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    total = np.concatenate((np.exp(vocabulary.logp), np.exp(vocabulary.byte_logp))) * prior
    np.add.at(total, uses["piece"].to_numpy(dtype=np.int64), uses["uses"].to_numpy(dtype=float))
    logp = np.log(total / total.sum())
    return vocabulary.with_scores(logp[: len(vocabulary.logp)], logp[len(vocabulary.logp) :])


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


#: What this worker knows of words under the scores in use, kept from task to task.
_known: dict[str, tuple[_Ids, np.ndarray, np.ndarray]] = {}


def _frequent(ids: _Ids, known: np.ndarray, uses: np.ndarray) -> tuple[_Ids, np.ndarray, np.ndarray]:
    """The more frequent words, half of what may be remembered at most; their uses count half from now on."""
    kept = np.sort(np.argsort(-uses, kind="stable")[: REMEMBERED // 2])
    words = list(ids)
    return _Ids((words[i], k) for k, i in enumerate(kept.tolist())), known[:, kept], uses[kept] // 2


def _scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, *vocabularies = sent.value
        if key not in _known:
            _known.clear()
        ids, known, uses = _known.get(key, (_Ids(), np.zeros((2, 0)), np.zeros(0, np.int64)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if len(ids) > REMEMBERED:
                ids, known, uses = _frequent(ids, known, uses)
            sums, n = np.zeros((2, len(texts))), np.zeros(len(texts), np.int64)
            coded = []
            for k, text in enumerate(texts):
                words = (text or "").split()
                n[k] = len(words)
                coded.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            if len(ids) > known.shape[1]:
                fresh = list(ids)[known.shape[1] :]
                known = np.concatenate((known, word_scores(fresh, *vocabularies)), axis=1)
                uses = np.concatenate((uses, np.zeros(len(fresh), np.int64)))
            uses += np.bincount(np.concatenate(coded), minlength=len(uses)) if coded else 0
            _known[key] = ids, known, uses
            for k, c in enumerate(coded):
                sums[:, k] = known[:, c].sum(axis=1)
            null = np.array([t is None for t in texts], bool)
            size = np.array([len(t or "") for t in texts], np.int64)
            bits = -sums[1] / np.log(2) / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(size), pa.array(sums[0], mask=null), pa.array(sums[1], mask=null), pa.array(bits, mask=null | (n == 0))],
                names=["doc_id", "n_words", "n_chars", "prior_logprob", "logprob", "bits_per_char"],
            )

    return run


def lm_score(docs: DataFrame, path: str, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_words, n_chars, prior_logprob, logprob, bits_per_char) of every row of docs.

    prior_logprob is the natural logarithm of the text's marginal probability under the vocabulary's own scores, logprob the same under
    the scores fitted to this corpus; bits_per_char is -logprob / ln 2 / n_chars. Words are what white space parts, each with
    a word mark in front, so runs of white space count as one. Characters without a piece are spelled in bytes.

    A null text has null scores and counts 0; an empty or blank one has probability 1 (logprob 0) and null bits_per_char.
    Null ids stay; rows that repeat are scored one by one, and each counts in the corpus. Words of any length are
    scored whole, long ones in windows. Ids have to be integers. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = load_vocabulary(path)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, base, fit_scores(docs, base, prior)))
    return docs.mapInArrow(_scorer(sent), "doc_id long, n_words long, n_chars long, prior_logprob double, logprob double, bits_per_char double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)
