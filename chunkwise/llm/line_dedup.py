"""Line deduplication: range-partitioned line hashes, first occurrences streamed in order, bitmaps returned.

Only 128-bit hashes and positions are shuffled, never text. Ranges are equal stretches of the space of hashes, in which hashes lie
evenly, so that nothing has to be drawn for them. What a task knows to be repeats of a line that it has seen before is settled on the spot and dealt out
evenly, so that a line that very many documents share sends few rows to its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, unused

KEYED = "k1 long, k2 long, doc_id long, pos int, n_lines int, known int"
#: Lines that a task remembers as frequent.
FREQUENT = 1 << 16
FLAGS = "doc_id long, pos int, n_lines int, keep boolean"


class _Frequent:
    """Lines that occurred more than once in a batch, with the least place seen so far; of FREQUENT lines at most, which bounds memory only."""

    def __init__(self):
        self.keys = np.zeros(0, [("a", "i8"), ("b", "i8")])
        self.doc, self.pos = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Whether each line occurred before, at a lesser place; lesser places are remembered."""
        keys = _keys(a, b)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.zeros(len(a), bool)
        known = self.keys[at] == keys
        later = known & ((doc > self.doc[at]) | (doc == self.doc[at]) & (pos > self.pos[at]))
        less = np.flatnonzero(known & ((doc < self.doc[at]) | (doc == self.doc[at]) & (pos < self.pos[at])))
        less = less[np.lexsort((pos[less], doc[less]))[::-1]]  # the least is put down last
        self.doc[at[less]], self.pos[at[less]] = doc[less], pos[less]
        return later

    def add(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        keys = _keys(a, b)
        fresh = np.flatnonzero(~np.isin(keys, self.keys))[: FREQUENT - len(self.keys)]
        keys, doc, pos = (np.concatenate((x, y[fresh])) for x, y in ((self.keys, keys), (self.doc, doc), (self.pos, pos)))
        order = np.argsort(keys, order=("a", "b"))
        self.keys, self.doc, self.pos = keys[order], doc[order], pos[order]


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), [("a", "i8"), ("b", "i8")])
    out["a"], out["b"] = a, b
    return out


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark what is surely a repeat of a line of this task and scatter it, so that no frequent line fills one range."""
    frequent = _Frequent()
    for batch in batches:
        k1, k2, doc, pos, n, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        k1, known = k1.copy(), known.copy()
        order = np.lexsort((pos, doc, k2, k1))
        order = order[known[order] == 0]
        a, b, d, p = k1[order], k2[order], doc[order], pos[order]
        first = np.ones(len(order), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
        # a row that repeats is no repeat of its own line
        again = ((d != d[head]) | (p != p[head])) | frequent.later(a, b, d, p)
        several = np.flatnonzero(first & np.concatenate((~first[1:], [False]))) if len(order) else np.zeros(0, np.int64)
        frequent.add(a[several], b[several], d[several], p[several])
        hit = order[again]
        known[hit] = 1
        scatter = doc[hit].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pos[hit].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        k1[hit] = scatter.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, doc, pos, n, known)], names=["k1", "k2", "doc_id", "pos", "n_lines", "known"])


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream a sorted range; a line is kept where its hash differs from that of the line before."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, doc, pos, n, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        open_ = np.flatnonzero(known == 0)
        keep = known == 2
        if len(open_):
            a, b, d, p = k1[open_], k2[open_], doc[open_], pos[open_]
            new = np.ones(len(open_), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if last is not None and last[:2] == (a[0], b[0]):
                new[0] = False
            # the first occurrence's own place, so that repeated rows of one document agree
            head = np.maximum.accumulate(np.where(new, np.arange(len(open_)), -1))
            fd = np.where(head >= 0, d[head], last[2] if last else 0)
            fp = np.where(head >= 0, p[head], last[3] if last else 0)
            keep[open_] = (d == fd) & (p == fp)
            last = (a[-1], b[-1], fd[-1], fp[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos), pa.array(n), pa.array(keep)], names=["doc_id", "pos", "n_lines", "keep"])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _runs(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for n, at in zip(n_lines, dropped):
        bits = np.ones(n, bool)
        bits[np.asarray(at, dtype=np.int64)] = False
        edges = np.flatnonzero(np.diff(np.concatenate(([True], bits))))
        out.append(np.diff(np.concatenate(([0], edges, [n]))).astype(np.int32))
    return pd.Series(out)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per-document bitmaps of the lines to keep, run-length compressed: (doc_id, n_lines, n_kept, runs).

    A line is what stands between newlines, compared without leading and trailing blanks; of equal lines
    the one with the least (document, position) is kept. `runs` holds lengths of alternating runs, the first
    of kept lines (0 if the document begins with a dropped one).

    Ids have to be integers. Null ids have no row. Null and empty texts, and blank lines, are kept: an empty text is one blank line.
    Rows that repeat a document share one bitmap, as long as their longest text. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 50_000)
    lines = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("__lines"))
        .where("doc_id is not null")
        .select("doc_id", F.size("__lines").alias("n_lines"), F.posexplode("__lines").alias("pos", "__line"))
        .withColumn("__line", F.trim("__line"))
        .where("__line <> '' or pos = 0")
    )
    blank = F.col("__line") == ""
    keyed = lines.select(
        F.when(blank, F.xxhash64("doc_id")).otherwise(F.xxhash64("__line")).alias("k1"),
        F.xxhash64(F.lit(7), "__line").alias("k2"), "doc_id", "pos", "n_lines", F.when(blank, 2).otherwise(0).alias("known"),
    )
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the upper 32 bits, from 0: where in the space of hashes a line lies
    place = F.shiftright("k1", 32) + F.lit(1 << 31)
    ranged = keyed.mapInArrow(_spread, KEYED).withColumn("range", F.shiftright(place * ranges, 32).cast("int"))
    ranged = ranged.repartitionById(ranges, "range").drop("range").sortWithinPartitions("k1", "k2", "doc_id", "pos")
    flags = ranged.mapInArrow(_firsts, FLAGS)
    dropped = F.array_distinct(F.collect_list(F.when(~F.col("keep"), F.col("pos"))))
    per_doc = flags.groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"), dropped.alias("__dropped"))
    return per_doc.select("doc_id", "n_lines", (F.col("n_lines") - F.size("__dropped")).alias("n_kept"), _runs("n_lines", "__dropped").alias("runs"))


@F.pandas_udf(T.StringType())
def _rebuild(text: pd.Series, runs: pd.Series) -> pd.Series:
    out = []
    for t, r in zip(text, runs):
        if t is None or r is None or len(r) < 2:
            out.append(t)
            continue
        lines, at, kept, keep = t.split("\n"), 0, [], True
        for n in r:
            if keep:
                kept += lines[at : at + n]
            at, keep = at + n, not keep
        out.append("\n".join(kept))
    return pd.Series(out)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without their repeated lines; one that loses every line that isn't blank is dropped.

    Documents with a null id, a null text or nothing to drop stay as they are. n_chars, if there, is set anew for
    texts that changed. Rows that repeat an id are cut by the same bitmap. An empty table stays empty; all columns are kept, whatever their names.
    """
    key, runs, body = unused(docs, "__id", "__runs", "__text")
    maps = keep_bitmaps(docs).where("n_kept < n_lines").select(F.col("doc_id").alias(key), F.col("runs").alias(runs))
    joined = docs.join(maps, F.col("doc_id") == F.col(key), "left")
    same = F.col(runs).isNull()
    out = joined.withColumn(body, F.when(same, F.col("text")).otherwise(_rebuild("text", runs)))
    out = out.where(same | (F.trim(F.regexp_replace(body, "\\s+", " ")) != "") | F.col(body).isNull())
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(body).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(same, F.col(c)).otherwise(F.length(body).cast("long")).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_bitmaps(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = """
WITH lines AS (
  SELECT doc_id, len(ls) AS n_lines, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), flags AS (
  SELECT doc_id, n_lines, pos,
         trim(line, ' ') = '' OR row_number() OVER (PARTITION BY trim(line, ' ') ORDER BY doc_id, pos) = 1 AS keep
  FROM lines
), islands AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, keep ORDER BY pos) AS island
  FROM flags
), runs AS (
  SELECT doc_id, n_lines, keep, min(pos) AS start_pos, count(*)::INTEGER AS n FROM islands GROUP BY doc_id, n_lines, keep, island
)
SELECT doc_id, n_lines::INTEGER AS n_lines, sum(CASE WHEN keep THEN n ELSE 0 END)::INTEGER AS n_kept,
       CASE WHEN NOT first(keep ORDER BY start_pos) THEN list_prepend(0::INTEGER, list(n ORDER BY start_pos)) ELSE list(n ORDER BY start_pos) END AS runs
FROM runs GROUP BY doc_id, n_lines
"""
