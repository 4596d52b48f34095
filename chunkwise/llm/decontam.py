"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

The automaton holds each item cut into pieces of a few words, so it is as large as the benchmark and no larger.
A run shared with an item that is long enough contains a whole piece, wherever it begins; each hit is
then extended word by word on both sides, once for each run. Items too short for that are one piece that has to match as a whole.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, unused

#: Words of a shared run that counts; an item of fewer than LEAST words is reported but is no reason to drop a document.
RUN, LEAST = 13, 5
#: A benchmark beyond this many characters is scanned in several automata, one pass for each. An automaton takes some 40 bytes for each.
AUTOMATON_CHARS = 16 << 20
APART = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, start_char int, end_char int, n_words int"


def _plain(text: str) -> bool:
    return text.isascii() or unicodedata.is_normalized("NFKC", text)


def _joins(ch: str) -> bool:
    """Whether a character belongs to the letter before it: a mark, or a later part of a Korean syllable."""
    return bool(unicodedata.combining(ch)) or 0x1160 <= ord(ch) < 0x1200


def _low(text: str) -> tuple[str, list[int]]:
    """The text in one normal form (NFKC, letter by letter with its marks) and lower case, and where each character comes from."""
    low, back, i, plain = [], [], 0, _plain(text)
    while i < len(text):
        j = i + 1
        while not plain and j < len(text) and _joins(text[j]):
            j += 1
        one = text[i:j] if plain else unicodedata.normalize("NFKC", text[i:j])
        own = one.lower().replace("ς", "σ")
        low.append(own)
        back += [i] * len(own)
        i = j
    return "".join(low), back


def normalise(text: str) -> str:
    """Lower-cased runs of letters and digits between single blanks, with a blank at either end. Composed and decomposed letters are alike."""
    low = text.lower().replace("ς", "σ") if _plain(text) else _low(text)[0]
    return " " + APART.sub(" ", low).strip(" ") + " "


def offsets(text: str) -> list[tuple[int, int]]:
    """Where each word of normalise(text) begins and ends in the original; a word ends behind the marks of its last letter."""
    low, back = _low(text)
    ends, plain = [b + 1 for b in back], _plain(text)
    if not plain:
        for k, b in enumerate(ends):
            while b < len(text) and _joins(text[b]):
                b += 1
            ends[k] = b
    return [(back[m.start()], ends[m.end() - 1]) for m in WORD.finditer(low)]


def pieces(items: list[tuple[int, str]], run: int = RUN) -> tuple[dict[str, list[tuple[int, int]]], dict[int, list[str]]]:
    """Patterns, each with the items and word positions it stands for, and the items' words."""
    step, patterns, words = (run + 1) // 2, {}, {}
    for item, text in items:
        w = normalise(text).split()
        if not w:
            continue
        words[item] = w
        cuts = [(0, len(w))] if len(w) < run else [(k, k + step) for k in range(0, len(w) - step + 1, step)]
        for a, b in cuts:
            patterns.setdefault(" " + " ".join(w[a:b]) + " ", []).append((item, a))
    return patterns, words


def automaton(patterns: dict[str, list[tuple[int, int]]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p, at in patterns.items():
        out.add_word(p, (len(p), at))
    out.make_automaton()
    return out


def scan(text: str, machine: ahocorasick.Automaton, words: dict[int, list[str]], run: int = RUN) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words) of each maximal shared run, in characters of the original."""
    norm = normalise(text)
    hits = [(end - n + 1, at) for end, (n, at) in machine.iter(norm)]
    if not hits:
        return []
    w, found = norm.split(), []
    blanks = [m.start() for m in re.finditer(" ", norm)]
    upto: dict[tuple[int, int], int] = {}
    for blank, at in sorted(hits, key=lambda h: h[0]):
        first = bisect_left(blanks, blank)
        for item, a in at:
            own, diagonal = words[item], (item, first - a)
            if first < upto.get(diagonal, 0):
                continue  # within a run that was followed to its end
            i, j = first, a
            while i > 0 and j > 0 and w[i - 1] == own[j - 1]:
                i, j = i - 1, j - 1
            x, y = first, a
            while x < len(w) and y < len(own) and w[x] == own[y]:
                x, y = x + 1, y + 1
            upto[diagonal] = x
            if x - i >= min(run, len(own)):
                found.append((item, i, x))
    places = offsets(text) if found else []
    return sorted((item, places[i][0], places[x - 1][1], x - i) for item, i, x in found)


def contamination(docs: DataFrame, benchmark: DataFrame, run: int = RUN) -> DataFrame:
    """Every maximal run of at least `run` words that a document shares with a test item: (doc_id, item_id, start_char, end_char, n_words).

    An item of fewer than `run` words, down to one, counts if all of it occurs. Positions are
    characters of the original text, the end exclusive. Case, punctuation, spacing and the composition of letters don't matter. Null or empty
    texts and items match nothing; null item ids are left out; a null doc_id is reported as null. Repeated rows report as often as they occur, repeated
    items once. Ids have to be integers. Other columns are ignored; an empty table gives no rows. The benchmark goes to the executors in
    automata of at most AUTOMATON_CHARS and one item each, one narrow pass over the documents for each of them; one alone up to that size.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    groups, held = [[]], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct().toLocalIterator():
        if held > AUTOMATON_CHARS:
            groups.append([])
            held = 0
        groups[-1].append((row[0], row[1]))
        held += len(row[1])
    out = None
    for group in groups:
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(_numbered(group)))
        one = docs.mapInArrow(_scanner(sent, run), SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def _numbered(items: list[tuple[int, str]]) -> list[tuple[int, int, str]]:
    return [(k, i, t) for k, (i, t) in enumerate(items)]


_built: dict[int, tuple] = {}


def _scanner(sent, run: int):
    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((sent.value, run))
        if key not in _built:
            _built.clear()
            items = pickle.loads(sent.value)
            patterns, words = pieces([(k, t) for k, _, t in items], run)
            _built[key] = (automaton(patterns), words, [i for _, i, _ in items]) if patterns else None
        if _built[key] is None:
            return
        machine, words, ids = _built[key]
        for batch in batches:
            rows = [(d, ids[item], a, b, n) for d, text in zip(batch.column(0).to_pylist(), batch.column(1)) for item, a, b, n in scan(text.as_py(), machine, words, run)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "start_char", "end_char", "n_words"])

    return scan_batches


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN, least: int = LEAST) -> DataFrame:
    """The documents that share no run with the benchmark, with all their columns.

    An item of fewer than `least` words, which may stand anywhere by chance, condemns a document only beside a run of `least` words or more. Null ids stay,
    as nothing can name them; all rows of an id go together; an empty table stays empty.
    """
    (key,) = unused(docs, "__hit")
    hit = contamination(docs, benchmark, run).where((F.col("n_words") >= least) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(hit, F.col("doc_id") == F.col(key), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS k FROM documents WHERE text IS NOT NULL),
split AS (
  SELECT k, doc_id, regexp_matches(text, '^[\p{{L}}\p{{N}}]') AS bare,
         regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS ws, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]+') AS gaps FROM d
), pos AS (
  SELECT k, doc_id, i, lower(w) AS w, length(w) AS n, length(CASE WHEN bare THEN CASE WHEN i > 1 THEN gaps[i - 1] END ELSE gaps[i] END) AS gap
  FROM (SELECT *, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split)
), words AS (
  SELECT k, doc_id, i, w, n, sum(n + coalesce(gap, 0)) OVER (PARTITION BY k ORDER BY i) AS upto FROM pos
), lists AS (SELECT k, list(w ORDER BY i) AS ws FROM words GROUP BY k),
items AS (
  SELECT item_id, text, len(ws) AS len, ws, least(len(ws), {RUN}) AS need FROM (
    SELECT item_id, text, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w)) AS ws
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)) WHERE len(ws) > 0
), parts AS (
  SELECT item_id, text, need, j, array_to_string(ws[j:j + need - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len - need + 2)) AS j FROM items)
), grams AS (
  SELECT k, need, i, array_to_string(ws[i:i + need - 1], ' ') AS g
  FROM (SELECT k, ws, need, unnest(range(1, len(ws) - need + 2)) AS i FROM lists, (SELECT DISTINCT need FROM items) WHERE len(ws) >= need)
), hits AS (SELECT k, item_id, text, parts.need, i, i - j AS diagonal FROM grams JOIN parts ON grams.need = parts.need AND grams.g = parts.g),
islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY k, item_id, text, diagonal ORDER BY i) AS island FROM hits
), runs AS (SELECT k, item_id, min(i) AS a, max(i) + any_value(need) - 1 AS b FROM islands GROUP BY k, item_id, text, diagonal, island)
SELECT x.doc_id, item_id, (x.upto - x.n)::INTEGER AS start_char, y.upto::INTEGER AS end_char, (b - a + 1)::INTEGER AS n_words
FROM runs JOIN words x ON x.k = runs.k AND x.i = a JOIN words y ON y.k = runs.k AND y.i = b
"""
