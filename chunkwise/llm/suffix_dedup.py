"""Repeated passages by a suffix array over words, built by the distributed difference-cover algorithm.

Only words that may lie in a repeated passage go into the array. Winnowing picks words so that two equal passages have a pick in common,
wherever they stand; where no pick of a stretch occurs elsewhere, nothing in it is repeated. That drops no repeat and cuts the array to
the repeated part of the corpus. Equal texts go in once.

Each level sorts the triples at positions 1 and 2 modulo 3, names them by rank, recurses on the names unless they differ,
and merges the remaining suffixes, which are ordered by a word and the rank of what follows it. A level of at most BASE names is ordered by one
task. On the first level, suffixes next to each other are compared in their first LEAST words as they come out of the merge.

A string is a row: sid names it, its symbols are a blob. The last symbol of a string occurs nowhere else on its level, so
suffixes never run on into another string. The names of a string's triples at 1 and then at 2 modulo 3 are a string of the next level; the last
triple at 1 holds the end of the string, so it parts the two.

What is sorted moves as packed columns: a task sorts its tuples, cuts them at the bounds of ranges, which are drawn from a sample of
the level, and sends each range one blob. Every level is written to the shared folder.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, mix, small_batches, table

#: Words of a passage that counts as repeated; words of a pick.
LEAST, GRAM = 50, 24
#: Names that one task orders in memory; deeper levels than this aren't distributed.
BASE = 1 << 20
#: Tuples of a range, about; ranges of a level, at most; drawn tuples for each bound.
PART, MOST_PARTS, DRAWN = 1 << 19, 20_000, 24
STRINGS = "sid long, syms binary"
SENT = "part int, blob binary"
_M = np.uint64(0x9E3779B97F4A7C15)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Bytes that are hashed together.
BYTES = 1 << 21


def _blank_spaces(data: np.ndarray) -> np.ndarray:
    """UTF-8 with blanks in place of the spaces beyond ASCII."""
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if not len(at):
        return data
    first, second, third = data[at].astype(np.int32), _ahead(data, 1)[at].astype(np.int32), _ahead(data, 2)[at]
    two = (first == 0xC2) & ((second == 0x85) | (second == 0xA0))
    code = (first & 15) << 12 | (second & 63) << 6 | third & 63
    three = (first > 0xC2) & np.isin(code, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    if two.any() or three.any():
        data = data.copy()
        for k, own in ((0, two | three), (1, two | three), (2, three)):
            data[at[own] + k] = 32
    return data


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Odd 64-bit hashes of what white space parts, of all texts end to end, and how many each text has. Even numbers end strings."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    at = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at, codes, lengths = at - at[0], [], np.zeros(n, np.int64)
    cuts = np.unique(np.concatenate(([0], np.searchsorted(at, np.arange(BYTES, len(data), BYTES)), [n])))
    for x, y in zip(cuts[:-1], cuts[1:]):
        own = _blank_spaces(data[at[x] : at[y]])
        space = _SPACE[own]
        fresh = np.ones(len(own), bool)
        fresh[1:] = space[:-1]
        begins = at[x:y] - at[x]
        fresh[begins[begins < len(own)]] = True
        starts = np.flatnonzero(fresh & ~space)
        if not len(starts):
            continue
        size = np.diff(np.concatenate((starts, [len(own)])))
        power = np.ones(int(size.max()), np.uint64)
        power[1:] = _M | np.uint64(1)
        power = np.cumprod(power, dtype=np.uint64)
        place = np.arange(starts[0], len(own), dtype=np.int64) - np.repeat(starts, size)
        value = _BYTE[own[starts[0] :]] * power[place]
        value[space[starts[0] :]] = 0
        codes.append(mix(np.add.reduceat(value, starts - starts[0])) | np.uint64(1))
        lengths[x:y] = np.diff(np.searchsorted(starts, np.concatenate((begins, [len(own)]))))
    return np.concatenate(codes) if codes else np.zeros(0, np.uint64), lengths


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols from each position on, over the whole array; the last n - 1 are of no use."""
    total, done, part, width = np.zeros(len(codes), np.uint64), 0, mix(codes + _M), 1
    while n:
        if n & 1:
            total = mix(total * _M + _ahead(part, done) + np.uint64(width))
            done += width
        n >>= 1
        if n:
            part = mix(part * _M + _ahead(part, width) + np.uint64(width))
            width *= 2
    return total


def _ahead(x: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
    """x[i + k] at i."""
    out = np.full(len(x), fill, x.dtype)
    if k < len(x):
        out[: len(x) - k] = x[k:]
    return out


def _slide(x: np.ndarray, n: int, best: np.ufunc, fill: int) -> np.ndarray:
    """The least or greatest of x[i : i + n] at i."""
    width, out = 1, x
    while 2 * width <= n:
        out = best(out, _ahead(out, width, fill))
        width *= 2
    return best(out, _ahead(out, n - width, fill)) if n > width else out


def picks(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of picked grams of texts laid end to end; every passage of `least` words within a text holds one that depends on it alone."""
    n = len(codes)
    ends = np.repeat(np.cumsum(lengths), lengths)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(np.arange(n) + gram <= ends, grams(codes, gram) >> np.uint64(1), top)
    wide = least - gram + 1
    low = _slide(h, wide, np.minimum, int(top))
    # a pick is the least of some window that holds it: the greatest of the windows' minima equals it
    high = _slide(low[::-1], wide, np.maximum, 0)[::-1]
    at = np.flatnonzero((h == high) & (h != top))
    return at, h[at]


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def viable(codes: np.ndarray, again: np.ndarray, least: int = LEAST, gram: int = GRAM) -> np.ndarray:
    """Where a passage of `least` words may begin that occurs elsewhere: its least gram has to be among `again`, the sorted picks that occur elsewhere."""
    n = len(codes) - least + 1
    if n < 1 or not len(again):
        return np.zeros(0, np.int64)
    low = _slide(grams(codes, gram)[: len(codes) - gram + 1] >> np.uint64(1), least - gram + 1, np.minimum, 0xFFFFFFFFFFFFFFFF)[:n]
    return np.flatnonzero(again[np.minimum(np.searchsorted(again, low), len(again) - 1)] == low)


def _texts(least: int, gram: int):
    """doc_id, h1, h2, text -> a row for each text of at least `least` words, with its picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = word_codes(batch.column(3))
            rows = np.flatnonzero(lengths >= least)
            at, h = picks(codes, lengths, least, gram)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            edges = np.searchsorted(at, starts)
            took = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), batch.column(2).take(took), pa.array(lengths[rows]), _blobs([h[edges[i] : edges[i + 1]] for i in rows])],
                names=["doc_id", "h1", "h2", "n_words", "picked"],
            )

    return run


Columns = dict[str, np.ndarray]


def parts_for(tuples: int) -> int:
    return int(min(max(1, -(-tuples // PART)), MOST_PARTS))


def _sent(columns: Columns, order: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Rows (part, blob) of the stretches of `order` between cuts; part k is the k-th stretch."""
    edges = np.concatenate(([0], cuts, [len(order)]))
    full = np.flatnonzero(np.diff(edges))
    sorted_ = [c[order] for c in columns.values()]
    blobs = [b"".join(c[edges[k] : edges[k + 1]].tobytes() for c in sorted_) for k in full]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "blob"])


def by_hash(columns: Columns, key: str, parts: int) -> pa.RecordBatch:
    part = (mix(columns[key].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return _sent(columns, order, np.searchsorted(part[order], np.arange(1, parts)))


def by_range(columns: Columns, keys: list[np.ndarray], bounds: list[np.ndarray]) -> pa.RecordBatch:
    """Send to the range between two bounds, in lexicographic order of the keys."""
    order = np.lexsort(keys[::-1])
    own = [k[order] for k in keys]
    low, high = np.zeros(len(bounds[0]), np.int64), np.full(len(bounds[0]), len(order))
    while (low < high).any():
        mid = np.minimum((low + high) // 2, len(order) - 1)
        less, equal = np.zeros(len(low), bool), low < high
        for k, b in zip(own, bounds):
            less |= equal & (k[mid] < b)
            equal &= k[mid] == b
        low, high = np.where(less, mid + 1, low), np.where(less | (low >= high), high, mid)
    return _sent(columns, order, low)


def _received(names: list[str], work: Callable[[int, Columns], Iterator[pa.RecordBatch]]):
    """Hand `work` each part as a whole; a part is what bounds or hashes made small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(blob)
        width = sum(KINDS[c].itemsize for c in names)
        for part in sorted(held):
            blobs, columns, at = held.pop(part), {}, 0
            sizes = [len(x) // width for x in blobs]
            for c in names:
                columns[c] = np.concatenate([np.frombuffer(x, KINDS[c], n, at * n) for x, n in zip(blobs, sizes)])
                at += KINDS[c].itemsize
            del blobs
            yield from work(part, columns)

    return run


#: Kinds of the columns that move.
KINDS = {c: np.dtype(k) for c, k in {"h": "i8", "tid": "i8", "known": "i1", "a": "i8", "b": "i8", "c": "i8", "sid": "i8", "j": "i4", "number": "i8", "k0": "i8", "k1": "i8", "x": "i8", "y": "i8", "g": "i8"}.items()}


def _moved(sent: DataFrame, parts: int) -> DataFrame:
    return sent.repartitionById(parts, "part")


def _each_pick(parts: int):
    """(tid, picked) -> picks by hash. Where a pick occurs again within the batch, that is settled, and one row stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            if not own or not sum(map(len, own)):
                continue
            h, tid = np.concatenate(own), np.repeat(batch.column(0).to_numpy(), [len(x) for x in own])
            order = np.argsort(h, kind="stable")
            h, tid = h[order], tid[order]
            same = h[1:] == h[:-1]
            known = np.concatenate((same, [False])) | np.concatenate(([False], same))
            one = np.flatnonzero(known & np.concatenate(([True], ~same)))
            open_ = ~known
            yield by_hash({"h": np.concatenate((h[open_], h[one])), "tid": np.concatenate((tid[open_], np.full(len(one), -1))), "known": np.zeros(open_.sum() + len(one), np.int8)}, "h", parts)
            yield by_hash({"h": h[known], "tid": tid[known], "known": np.ones(known.sum(), np.int8)}, "tid", parts)

    return run


def _again(parts: int):
    """Picks that another row has, to their texts. Those of one text that its other picks repeat are settled already."""

    def work(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
        open_ = np.flatnonzero(t["known"] == 0)
        open_ = open_[np.argsort(t["h"][open_], kind="stable")]
        h = t["h"][open_]
        same = h[1:] == h[:-1]
        again = open_[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(h) else open_
        kept = np.concatenate((again[t["tid"][again] >= 0], np.flatnonzero(t["known"])))
        yield by_hash({"tid": t["tid"][kept], "h": t["h"][kept]}, "tid", parts)

    return _received(["h", "tid", "known"], work)


def _of_texts(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
    """(tid, h) -> a row for each text with its recurring picks, sorted."""
    order = np.lexsort((t["h"].view(np.uint64), t["tid"]))
    tid, h = t["tid"][order], t["h"][order]
    edges = np.flatnonzero(np.concatenate(([True], tid[1:] != tid[:-1], [True]))) if len(tid) else np.zeros(1, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(tid[edges[:-1]]), _blobs([h[a:b] for a, b in zip(edges[:-1], edges[1:])])], names=["tid", "again"])


def _segments(least: int, gram: int):
    """tid, again, text -> stretches that may hold repeats: (tid, start, syms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, starts, blobs = [], [], []
            every, lengths = word_codes(batch.column(2))
            for tid, again, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.split(every, np.cumsum(lengths)[:-1])):
                a = viable(codes, np.frombuffer(again, np.uint64), least, gram)
                if not len(a):
                    continue
                cuts = np.flatnonzero(a[1:] > a[:-1] + least) + 1
                for x, y in zip(a[np.concatenate(([0], cuts))], a[np.concatenate((cuts - 1, [len(a) - 1]))] + least):
                    tids.append(tid), starts.append(x), blobs.append(codes[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(starts, pa.int32()), _blobs(blobs)], names=["tid", "start", "syms"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, syms -> strings that end in a symbol of their own."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c + np.int64(2 * s).tobytes() for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], pa.binary())], names=["sid", "syms"])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of strings laid end to end, and their lengths."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.int64), np.array([len(b) // 8 for b in blobs], np.int64)


def _inside(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings laid end to end: position within the string, and symbols left from there on."""
    starts = np.cumsum(lengths) - lengths
    i = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    return i, np.repeat(lengths, lengths) - i


def _of_sample(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the sampled suffixes of strings, those at 1 and then those at 2 modulo 3: the string, and the position in it."""
    first, n = (lengths + 1) // 3, (lengths + 1) // 3 + lengths // 3
    which = np.repeat(np.arange(len(lengths)), n)
    j, _ = _inside(n)
    return which, np.where(j < first[which], 3 * j + 1, 3 * (j - first[which]) + 2)


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
    """(sid, syms) -> triples of the sampled suffixes, each with its place j among those of its string."""
    for batch in batches:
        if not batch.num_rows:
            continue
        t, lengths = _flat(batch.column(1))
        i, left = _inside(lengths)
        b, c = np.where(left > 1, _ahead(t, 1), 0), np.where(left > 2, _ahead(t, 2), 0)
        which, pos = _of_sample(lengths)
        at = (np.cumsum(lengths) - lengths)[which] + pos
        j, _ = _inside(np.bincount(which, minlength=len(lengths)))
        yield {"a": t[at], "b": b[at], "c": c[at], "sid": batch.column(0).to_numpy()[which], "j": j.astype(np.int32)}


def _prefixes(least: int):
    """(sid, syms) -> the first four symbols of all suffixes that go into the merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[Columns]:
        for batch in batches:
            if batch.num_rows:
                t, lengths = _flat(batch.column(1))
                yield dict(enumerate(k[_merging(lengths, least)] for k in _four(t, lengths)))

    return run


def _four(t: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    left = _inside(lengths)[1]
    return [t, *(np.where(left > k, _ahead(t, k), 0) for k in (1, 2, 3))]


def _merging(lengths: np.ndarray, least: int) -> np.ndarray:
    """All suffixes, or if prefixes of `least` symbols are to be compared, those that have so many before the end."""
    return np.flatnonzero(_inside(lengths)[1] > least) if least else np.arange(int(lengths.sum()))


def _bounds(strings: DataFrame, keys: Callable, width: int, tuples: int) -> list[np.ndarray]:
    """Bounds of ranges of about PART tuples each, from an evenly drawn sample of all tuples."""
    parts = parts_for(tuples)
    step = max(1, tuples // (parts * DRAWN))

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for columns in keys(batches):
            own = list(columns.values())[:width]
            some = np.arange(-at % step, len(own[0]), step)
            at += len(own[0])
            yield pa.RecordBatch.from_arrays([pa.array(k[some]) for k in own], names=[f"k{n}" for n in range(width)])

    got = strings.select("sid", "syms").mapInArrow(drawn, ", ".join(f"k{n} long" for n in range(width))).toArrow() if parts > 1 else None
    if got is None or not got.num_rows:
        return [np.zeros(0, np.int64)] * width
    own = [c.to_numpy() for c in got.columns]
    order = np.lexsort(own[::-1])
    cuts = order[np.arange(1, parts) * len(order) // parts]
    _, first = np.unique(np.stack([k[cuts] for k in own], axis=1), axis=0, return_index=True)
    return [k[cuts[np.sort(first)]] for k in own]


def _numbers(part: int, local: np.ndarray, tied: np.ndarray) -> np.ndarray:
    """Numbers in the order of all ranges, equal where local ones are: the range, the number in it, and a bit for those that others share."""
    return (np.int64(part) << 40 | local) << 1 | tied


def _names(parts: int):
    """Number the triples of a range, equal ones alike, and send them to their strings."""

    def work(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((t["c"], t["b"], t["a"]))
        a, b, c = (t[k][order] for k in "abc")
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])))
        tied = ~(new & np.concatenate((new[1:], [True])))
        yield by_hash({"sid": t["sid"][order], "j": t["j"][order], "number": _numbers(part, np.cumsum(new), tied)}, "sid", parts)

    return _received(["a", "b", "c", "sid", "j"], work)


def _strings(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
    """Numbers of a part's strings -> the strings, how many of their symbols others have, and how many symbols."""
    order = np.lexsort((t["j"], t["sid"]))
    sid, value = t["sid"][order], t["number"][order]
    edges = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1], [True])))
    yield pa.RecordBatch.from_arrays([pa.array(sid[edges[:-1]]), _blobs([value[a:b] for a, b in zip(edges[:-1], edges[1:])]), pa.array(np.add.reduceat(value & 1, edges[:-1])), pa.array(np.diff(edges))], names=["sid", "syms", "tied", "n"])


def _gathered(numbered: DataFrame, parts: int) -> DataFrame:
    return cut(_moved(numbered, parts).mapInArrow(_received(["sid", "j", "number"], _strings), f"{STRINGS}, tied long, n long"))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All strings of a level, in one task -> ranks of their suffixes, by doubling the prefix that is ordered."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    rows = pa.Table.from_batches(own).combine_chunks()
    t, lengths = _flat(rows.column("syms"))
    n = len(t)
    _, rank = np.unique(t, return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    open_ = np.arange(n)
    while True:
        # only suffixes that share their prefix with others are ordered anew; a rank is the number of suffixes before
        size = np.bincount(rank[open_], minlength=n) if k == 1 else size
        if k == 1:
            first = np.cumsum(size) - size
            rank = first[rank]
            size = np.bincount(rank, minlength=n)
        open_ = open_[size[rank[open_]] > 1]
        if not len(open_):
            break
        after = rank[np.minimum(open_ + k, n - 1)]
        order = np.lexsort((after, rank[open_]))
        o, a, r = open_[order], after[order], rank[open_[order]]
        block = np.concatenate(([True], r[1:] != r[:-1]))
        new = block | np.concatenate(([True], a[1:] != a[:-1]))
        start = np.maximum.accumulate(np.where(block, np.arange(len(o)), 0))
        head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
        fresh = r + head - start
        np.subtract.at(size, r, 1)
        np.add.at(size, fresh, 1)
        rank[o] = fresh
        k *= 2
    edges = np.concatenate(([0], np.cumsum(lengths)))
    yield pa.RecordBatch.from_arrays([rows.column("sid").combine_chunks(), _blobs([rank[a:b] for a, b in zip(edges[:-1], edges[1:])])], names=["sid", "syms"])


def _tuples(least: int, bounds: list[np.ndarray]):
    """(sid, syms, ranks of the sampled suffixes) -> for each suffix a tuple by which it is merged, sent to its range.

    x and y are the ranks of the next two suffixes where the position is 0 modulo 3, that of the next and its own where it is 1, and
    its own and that of the one after the next where it is 2. g is the hash of the first `least` symbols.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t, lengths = _flat(batch.column(1))
            starts = np.cumsum(lengths) - lengths
            r = np.full(len(t), -1, np.int64)
            which, pos = _of_sample(lengths)
            r[starts[which] + pos] = np.frombuffer(b"".join(x for x in batch.column(2).to_pylist() if x), np.int64)
            i, left = _inside(lengths)
            one, two, c = np.where(left > 1, _ahead(r, 1), -1), np.where(left > 2, _ahead(r, 2), -1), i % 3
            at, keys = _merging(lengths, least), _four(t, lengths)
            columns = {"k0": t, "k1": keys[1], "x": np.where(c == 2, r, one), "y": np.where(c == 1, r, two), "sid": np.repeat(batch.column(0).to_numpy(), lengths), "j": i.astype(np.int32)}
            if least:
                columns["g"] = grams(t.view(np.uint64), least).view(np.int64)
            yield by_range({k: v[at] for k, v in columns.items()}, [k[at] for k in keys], bounds)

    return run


TUPLE = ["k0", "k1", "x", "y", "sid", "j"]


def merged_order(t: Columns) -> np.ndarray:
    """The order of the suffixes of a range of tuples.

    Within a group of equal (k0, k1), those at 0 and 1 modulo 3 are in order by x. Before each of them come as many of those at 2 as have a lesser y, against one at 0, or a lesser rank, against one at 1.
    """
    k0, k1, x, y, i = (t[k] for k in ("k0", "k1", "x", "y", "j"))
    n, c = len(k0), i % 3
    by = np.lexsort((x, k1, k0))
    new = np.concatenate(([True], (k0[by][1:] != k0[by][:-1]) | (k1[by][1:] != k1[by][:-1])))
    group = np.empty(n, np.int64)
    group[by] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    a, b = by[c[by] != 2], by[c[by] == 2]
    # ranks are made small, so that a group and a rank fit into one number
    both = np.unique(np.concatenate((x[b], y[b])))
    small = lambda v: np.searchsorted(both, v)
    m = len(both) + 1
    by_y, by_x = group[b] * m + small(y[b]), group[b] * m + small(x[b])
    want = group[a] * m + small(y[a])
    before = np.where(c[a] == 0, np.searchsorted(by_y, want), np.searchsorted(by_x, want)) - np.searchsorted(group[b], group[a])
    place = starts[group[a]] + np.arange(len(a)) - np.searchsorted(group[a], group[a]) + before
    out = np.full(n, -1, np.int64)
    out[place] = a
    out[out < 0] = b
    return out


def _ranked(parts: int):
    def work(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
        order = merged_order(t)
        yield by_hash({"sid": t["sid"][order], "j": t["j"][order], "number": _numbers(part, np.arange(len(order)), np.zeros(len(order), bool))}, "sid", parts)

    return _received(TUPLE, work)


def _neighbours(parts: int):
    """Suffixes that share their first words with the one before or after them in the array. Such are never in different ranges."""

    def work(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
        order = merged_order(t)
        g = t["g"][order]
        same = g[1:] == g[:-1]
        keep = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        yield by_hash({"sid": t["sid"][keep], "j": t["j"][keep]}, "sid", parts)

    return _received([*TUPLE, "g"], work)


def _release(spark: SparkSession) -> None:
    """Let go of finished levels' shuffle files; they would stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _merge_input(strings: DataFrame, ranks: DataFrame, symbols: int, least: int) -> DataFrame:
    """Tuples of all suffixes, in ranges by their first four symbols. A string of one symbol has no ranks."""
    bounds = _bounds(strings, _prefixes(least), 4, symbols)
    both = strings.select("sid", "syms").join(ranks.select("sid", F.col("syms").alias("ranks")), "sid", "left")
    return _moved(both.mapInArrow(_tuples(least, bounds), SENT), len(bounds[0]) + 1)


def _sampled(strings: DataFrame, symbols: int) -> DataFrame:
    """(sid, syms): the ranks of each string's suffixes at 1 modulo 3, then of those at 2."""
    spark = strings.sparkSession
    tuples = 2 * symbols // 3 + 1
    bounds, parts = _bounds(strings, _triples, 3, tuples), parts_for(tuples)

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _triples(batches):
            yield by_range(t, [t["a"], t["b"], t["c"]], bounds)

    sent = strings.select("sid", "syms").mapInArrow(triples, SENT)
    lower = _gathered(_moved(sent, len(bounds[0]) + 1).mapInArrow(_names(parts), SENT), parts)
    tied, n = lower.agg(F.sum("tied"), F.sum("n")).first()
    _release(spark)
    if not tied:
        return lower
    ranks = suffix_ranks(lower.select("sid", "syms"), n)
    drop_cut(lower)
    return ranks


def suffix_ranks(strings: DataFrame, symbols: int) -> DataFrame:
    """(sid, syms): for each position of the strings (sid, syms), a number that orders its suffix among those of all strings.

    strings is a table made by cut(), of `symbols` symbols; each string's last symbol occurs nowhere else.
    """
    if symbols <= BASE:
        return cut(strings.repartition(1).mapInArrow(_ordered, STRINGS))
    ranks, parts = _sampled(strings, symbols), parts_for(symbols)
    out = _gathered(_merge_input(strings, ranks, symbols, 0).mapInArrow(_ranked(parts), SENT), parts)
    drop_cut(ranks)
    _release(strings.sparkSession)
    return out


def _spans(least: int):
    """Marks of a part's strings -> (sid, a, b) of merged passages."""

    def work(part: int, t: Columns) -> Iterator[pa.RecordBatch]:
        if not len(t["sid"]):
            return
        order = np.lexsort((t["j"], t["sid"]))
        sid, i = t["sid"][order], t["j"][order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], (sid[1:] != sid[:-1]) | (i[1:] > i[:-1] + least))))
        last = np.concatenate((first[1:] - 1, [len(i) - 1]))
        yield pa.RecordBatch.from_arrays([pa.array(sid[first]), pa.array(i[first].astype(np.int32)), pa.array((i[last] + least).astype(np.int32))], names=["sid", "a", "b"])

    return _received(["sid", "j"], work)


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Every stretch of a document that passages of at least `least` words cover which occur elsewhere too: (doc_id, start_word, end_word).

    Words are what white space parts, as written; the end is exclusive. A passage counts if it occurs again anywhere, in another document or the
    same one, overlapping or not. Stretches that touch or overlap are one. Of a text that two documents share, all is repeated.

    Null ids, null and empty texts and those of fewer than `least` words have no rows. Rows that repeat id and text are one document;
    those that repeat an id with another text are documents of their own. Texts of any length go in whole. Other columns are ignored. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 20_000, "4m")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(3), "text")})
    seen = rows.select("doc_id", "h1", "h2", "text").mapInArrow(_texts(least, gram), "doc_id long, h1 long, h2 long, n_words long, picked binary")
    texts = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.collect_set("doc_id").alias("ids"), F.count("*").alias("n_rows"), F.first("n_words").alias("n_words"), F.first("picked").alias("picked"))
    texts = cut(texts.withColumn("tid", F.monotonically_increasing_id()))
    parts = parts_for(texts.agg(F.coalesce(F.sum(F.expr("length(picked) div 8")), F.lit(0))).first()[0])
    settled = _moved(texts.select("tid", "picked").mapInArrow(_each_pick(parts), SENT), parts).mapInArrow(_again(parts), SENT)
    again = _moved(settled, parts).mapInArrow(_received(["tid", "h"], _of_texts), "tid long, again binary")
    wanted = again.join(texts.select("tid", "rep", F.col("h1").alias("__h1"), F.col("h2").alias("__h2")), "tid")
    bodies = rows.join(wanted, (F.col("doc_id") == F.col("rep")) & (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).select("tid", "again", "text")
    segments = bodies.mapInArrow(_segments(least, gram), "tid long, start int, syms binary")
    if texts.where("n_rows > size(ids)").limit(1).count():
        segments = segments.dropDuplicates(["tid", "start"])
    segments = segments.withColumn("sid", F.monotonically_increasing_id())
    segments = cut(segments.select("sid", "tid", "start", "syms"))
    strings = segments.select("sid", "syms").mapInArrow(_ended, STRINGS)
    symbols = segments.agg(F.coalesce(F.sum(F.expr("length(syms) div 8 + 1")), F.lit(0))).first()[0]
    _release(spark)
    marks = _merge_input(strings, _sampled(strings, symbols), symbols, least).mapInArrow(_neighbours(parts_for(symbols)), SENT)
    spans = _moved(marks, parts_for(symbols)).mapInArrow(_spans(least), "sid long, a int, b int")
    owners = texts.select("tid", "ids", "n_words")
    found = spans.join(segments.select("sid", "tid", "start"), "sid").join(owners.where("size(ids) = 1"), "tid")
    found = found.select(F.col("ids")[0].alias("doc_id"), (F.col("start") + F.col("a")).alias("start_word"), (F.col("start") + F.col("b")).alias("end_word"))
    copies = owners.where("size(ids) > 1").select(F.explode("ids").alias("doc_id"), F.lit(0).alias("start_word"), F.col("n_words").cast("int").alias("end_word"))
    return found.unionByName(copies)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, k, i, md5(array_to_string(ws[i:i + {LEAST - 1}], ' ')) AS g FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - {LEAST - 2})) AS i FROM w WHERE len(ws) >= {LEAST})),
r AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
s AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY k ORDER BY i) + {LEAST} THEN 0 ELSE 1 END AS fresh FROM r),
t AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY i) AS island FROM s)
SELECT doc_id, (min(i) - 1)::INTEGER AS start_word, (max(i) - 1 + {LEAST})::INTEGER AS end_word FROM t GROUP BY doc_id, k, island
"""
