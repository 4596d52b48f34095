"""N-gram Jaccard self-join with count vectors in R-trees.

Tokens (word n-grams) are hashed into groups; the counts of a document's tokens by group are its point. The overlap of
two documents is at most the sum of the coordinates' minima, and that of a document with all in a box at most the sum of
the minima with the box's upper corner.

One R-tree over all points would not do: random texts lie so close together in that space that its boxes part
nothing, and the join would compare nearly all pairs. So documents first meet, over the cluster, in blocks of those that
have one of their first FIRST tokens in common, in an order that all share: by hash, tokens known as
frequent last. Each block has its R-tree; pairs that pass its bound link documents to clusters, and within a
cluster all pairs are searched by another R-tree and verified on the token sets.

Two near sets need not have any of those first tokens in common, so a second step goes over all tokens. Tokens that no other set has can't be
shared, and a set of n tokens of which fewer than threshold * n are found elsewhere has no partner. The others are ordered, rarest first; sets that
reach the threshold have one of the first k - threshold * n + 1 of their k tokens found elsewhere in common, wherever the rest lies. Sets that
such a token brings together, and that aren't in one cluster yet, meet in blocks as before. Nothing is left to chance but equal hashes.

Equal token sets go in once. Blocks and clusters of any size are split into tiles by hash, and each pair of tiles is a task's
work of bounded size. Neither step writes out pairs: a task returns a forest of its links and the number of links of each set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, flat, grouped, hashed_words, mix, shingle_hashes, small_batches, table, unused
from .components import components

NGRAM, THRESHOLD = 3, 0.5
#: Coordinates of a point within a cluster; entries of a tree node; tokens by which a document meets others.
GROUPS, FANOUT, FIRST = 64, 16, 10
#: Tokens of each document by which frequent ones are counted; documents that make one frequent; most that the executors are told.
COUNTED, OFTEN, FREQUENT = 32, 96, 200_000
#: Sets in a tile of a block, tokens in a tile of a cluster; larger ones are split, and every pair of tiles compared.
TILE_SETS, TILE_TOKENS = 2048, 1 << 20
#: Tokens that a task sends on at a time, parted by range; bounds memory, and how finely they are parted.
SENT_TOKENS = 1 << 21
#: Tokens of partners that are looked up together; bounds the memory of a verification, not what it covers.
AT_ONCE = 1 << 18


def _dims(n: np.ndarray | int) -> np.ndarray:
    """Coordinates of the point of n tokens: the next power of two, so that random sets have few counts in common."""
    return np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))), 64, 16384).astype(np.int64)


def _point(s: np.ndarray) -> bytes:
    """Counts of four bits where they are below 16, else of 8, 16 or 32; the length tells which."""
    counts = np.bincount((s & np.uint64(_dims(len(s)) - 1)).astype(np.int64), minlength=int(_dims(len(s))))
    if counts.max() < 16:
        return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65536 else np.uint32).tobytes()


def _unfold(point: bytes, d: int) -> np.ndarray:
    if 2 * len(point) == d:
        two, out = np.frombuffer(point, np.uint8), np.empty(d, np.int32)
        out[0::2], out[1::2] = two & 15, two >> 4
        return out
    return np.frombuffer(point, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(point) // d]).astype(np.int32)


def _first(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The tokens by which a sorted set meets others.

    Of the first COUNTED tokens, which are as good as drawn at random, the first FIRST that aren't frequent. Where half of them or more are
    frequent, two such sets may be near without sharing others, so the first tokens of all are added.
    """
    some = s[:COUNTED]
    at = np.minimum(np.searchsorted(hot, some), max(len(hot) - 1, 0))
    rare = some[hot[at] != some] if len(hot) else some
    return rare[:FIRST] if 2 * len(rare) > len(some) else np.union1d(rare[:FIRST], s[:FIRST])


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges of the space of hashes each is in: the upper half of h * ranges."""
    low = (h & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)
    return ((h >> np.uint64(32)) * np.uint64(ranges) + low >> np.uint64(32)).astype(np.int64)


def _within(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where in its range each is, in 32 bits."""
    return (h * np.uint64(ranges) >> np.uint64(32)).astype(np.uint32)


def _alike(sets: np.ndarray, at: np.ndarray, ranges: int) -> np.ndarray:
    """For each sorted set, how many of its tokens are like the one before in range and place."""
    where = _range(sets, ranges) << 32 | _within(sets, ranges).astype(np.int64)
    same = np.concatenate(([0], np.cumsum(where[1:] == where[:-1]), [0]))[: len(sets)] if len(sets) else np.zeros(0, np.int64)
    rows, out = np.flatnonzero(np.diff(at)), np.zeros(len(at) - 1, np.int32)
    out[rows] = same[at[rows + 1] - 1] - same[at[rows]]
    return out


def _tokens(column, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """The token sets of a column of texts, or of word hashes, and offsets."""
    return shingle_hashes(*(flat if pa.types.is_list(column.type) else hashed_words)(column), ngram)


def _met(ngram: int, ranges: int):
    """doc_id and text -> a row for each, with hashes and size of its token set, 0 where it has none, its first COUNTED tokens, and how many of its tokens are alike to _spread()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, at = _tokens(batch.column(1), ngram)
            h1, h2, own = _set_hashes(sets, at)
            lowest = [own_set[:COUNTED].view(np.int64) for own_set in own]
            points = [_point(own_set) if len(own_set) else b"" for own_set in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(h1), pa.array(h2), pa.array(np.diff(at).astype(np.int32)), pa.array(lowest, pa.list_(pa.int64())), pa.array(points, pa.binary()), pa.array(_alike(sets, at, ranges))],
                names=["doc_id", "h1", "h2", "n", "lowest", "point", "alike"],
            )

    return run


def _firsts(sent):
    """Rows with the tokens by which they meet others in place of their first COUNTED ones, in the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(sent.value, np.uint64)
        for batch in batches:
            tokens, at = flat(batch.column(0))
            firsts = [_first(tokens[a:b].view(np.uint64), hot).view(np.int64) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.list_(pa.int64())), *batch.columns[1:]], names=["firsts", *batch.schema.names[1:]])

    return run


def _set_hashes(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Two hashes of each token set, and the sets."""
    rows, out = np.flatnonzero(np.diff(at)), np.zeros((2, len(at) - 1), np.uint64)
    if len(rows):
        out[0, rows] = np.add.reduceat(mix(sets), at[rows])
        out[1, rows] = np.bitwise_xor.reduceat(mix(sets + np.uint64(0x1234567)), at[rows])
    return out[0].view(np.int64), out[1].view(np.int64), [sets[a:b] for a, b in zip(at[:-1], at[1:])]


class Forest:
    """Groups of numbers that links join."""

    def __init__(self, n: int):
        self.of, self.groups = np.arange(n), n

    def link(self, i: int, others: np.ndarray) -> None:
        mine = np.unique(self.of[others])
        mine = mine[mine != self.of[i]]
        if len(mine):
            self.of[np.isin(self.of, mine)] = self.of[i]
            self.groups -= len(mine)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(first of a group, other of that group) for all that aren't alone."""
        _, first, which = np.unique(self.of, return_index=True, return_inverse=True)
        root = first[which]
        others = np.flatnonzero(root != np.arange(len(root)))
        return root[others], others


def _block(sizes: np.ndarray, points: list[bytes], tile: np.ndarray, crossing: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs within a block, or between two tiles of one if `crossing`, that pass the bound.

    A set meets those of its own number of coordinates, and of up to 1 / threshold times as many, folded to its own; others differ too much in size.
    """
    dims, forest = _dims(sizes), Forest(len(sizes))
    for d in np.unique(dims):
        own, larger = np.flatnonzero(dims == d), np.flatnonzero((dims > d) & (dims * threshold < 2 * d))
        both = np.concatenate((own, larger))
        if len(both) < 2:
            continue
        at = np.stack([_unfold(points[i], int(dims[i])).reshape(-1, d).sum(axis=0) for i in both])
        n, side = sizes[both], tile[both]
        tree = CountTree(at)
        for i in range(len(own)):
            if forest.groups == 1:
                break  # all are linked, nothing can be added
            found = tree.query(at[i], int(n[i]), n, threshold)
            found = found[(found > i) if not crossing else (side[found] != side[i])]
            if len(found):
                forest.link(both[i], both[found])
    return forest.stars()


def _block_links(threshold: float):
    """Whole blocks, sorted by token and tiles -> links (u, v) that join what may be near."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        key = [rows.column(c).to_numpy() for c in ("token", "i", "j")]
        sids, sizes, tile, points = rows.column("sid").to_numpy(), rows.column("n").to_numpy().astype(np.int64), rows.column("tile").to_numpy(), rows.column("point")
        edges = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0), [True])))
        us, vs = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                u, v = _block(sizes[a:b], points.slice(a, b - a).to_pylist(), tile[a:b], key[1][a] != key[2][a], threshold)
                us.append(sids[a:b][u]), vs.append(sids[a:b][v])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"]) if us else None

    return grouped(["token", "i", "j"], work)


CELL = "part int, origin int, ids binary, more binary, counts binary, tokens binary, marks binary"


def _cells(part: np.ndarray, origin: int | None, ids: np.ndarray, more: np.ndarray | None, tokens: np.ndarray, marks: np.ndarray | None) -> pa.RecordBatch:
    """A row for each part: its tokens and marks, and the ids that they are of, with a count for each run of one."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")  # short numbers are sorted by their digits
    part, ids, tokens = part[order], ids[order], tokens[order]
    starts = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (ids[1:] != ids[:-1])))[: len(part)])
    counts, own, also = np.diff(np.append(starts, len(part))).astype(np.int32), ids[starts], None if more is None else more[order][starts]
    parts, first = np.unique(part, return_index=True)
    ends, runs = np.append(first, len(part)), np.searchsorted(starts, np.append(first, len(part)))
    marks = None if marks is None else marks[order]

    def blobs(x: np.ndarray | None, at: np.ndarray) -> pa.Array:
        return pa.array([b"" if x is None else x[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())

    origins = np.full(len(parts), -1 if origin is None else origin, np.int32)
    columns = [pa.array(parts.astype(np.int32)), pa.array(origins), blobs(own, runs), blobs(also, runs), blobs(counts, runs), blobs(tokens, ends), blobs(marks, ends)]
    return pa.RecordBatch.from_arrays(columns, names=["part", "origin", "ids", "more", "counts", "tokens", "marks"])


def _by_token(tokens: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places in the order of tokens of 32 bits, and of ids where those are alike; as np.lexsort() has it, by sorts of single numbers."""
    order = np.argsort(ids)
    return order[np.sort(tokens[order].astype(np.uint64) << np.uint64(32) | np.arange(len(ids), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)]


def _joined(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _spread(ngram: int, ranges: int):
    """Texts -> cells of all tokens by their range, with their sets' first hashes as ids; 32 bits stand for a token in its range."""

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tokens, ids = (np.concatenate(x) for x in zip(*held))
        return _cells(_range(tokens, ranges), None, ids, None, _within(tokens, ranges), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            sets, at = _tokens(batch.column(0), ngram)
            held.append((sets, np.repeat(_set_hashes(sets, at)[0], np.diff(at))))
            many += len(sets)
            if many >= SENT_TOKENS:
                yield send(held)
                held, many = [], 0
        if many:
            yield send(held)

    return run


def _shared(ranges: int):
    """The cells of a range of tokens -> cells of the tokens that two sets or more have, by range of their sets' hashes; marks are the numbers of sets, up to 255.

    Two tokens that are alike in 32 bits count as one, so sets may meet that have no token in common; what a set has too few for that, _prefixes() adds.
    """

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        tokens = _joined(rows.column("tokens"), np.uint32)
        ids = np.repeat(_joined(rows.column("ids"), np.int64), _joined(rows.column("counts"), np.int32))
        order = np.argsort(tokens)
        same = tokens[order[1:]] == tokens[order[:-1]]
        order = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        tokens, ids = tokens[order], ids[order]
        order = _by_token(tokens, ids)
        tokens, ids = tokens[order], ids[order]
        if len(tokens):  # a set of several documents comes more than once
            once = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])))
            tokens, ids = tokens[once], ids[once]
        many = np.diff(np.append(np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))[: len(tokens)], len(tokens)))
        many = np.repeat(many, many)
        tokens, ids, many = (x[many > 1] for x in (tokens, ids, many))
        if not len(tokens):
            return None
        order = np.argsort(ids)
        marks = np.minimum(many, 255).astype(np.uint8)[order]
        return _cells(_range(ids[order].view(np.uint64), ranges), rows.column("part")[0].as_py(), ids[order], None, tokens[order], marks)

    return grouped(["part"], work)


def _known(ranges: int):
    """h1, sid, n, alike and comp of sets -> cells of them by range of h1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            fields = np.stack([c.to_numpy().astype(np.int64) for c in pa.Table.from_batches(held).columns], axis=1)
            yield _cells(_range(np.ascontiguousarray(fields[:, 0]).view(np.uint64), ranges), None, fields[:, 0], None, fields, None)

    return run


def _prefixes(threshold: float):
    """The cells of a range of sets -> cells of the tokens of which two near sets share one, by range of tokens; ids are sids, more their clusters.

    Marked are those of which one is shared with a set that is as large or larger. Where `alike` tokens of a set count as others, it may share that many less.
    """

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        origin = rows.column("origin").to_numpy()
        known, found = rows.filter(pa.array(origin < 0)), rows.filter(pa.array(origin >= 0))
        if not len(found):
            return None
        h1, sid, n, alike, comp = _joined(known.column("tokens"), np.int64).reshape(-1, 5).T
        tokens, many = _joined(found.column("tokens"), np.uint32), _joined(found.column("marks"), np.uint8)
        counts = [np.frombuffer(c, np.int32) for c in found.column("counts").to_pylist()]
        ranges = np.repeat(origin[origin >= 0], [c.sum() for c in counts])
        sets = np.argsort(h1, kind="stable")
        which = np.repeat(np.searchsorted(h1[sets], _joined(found.column("ids"), np.int64)), np.concatenate(counts)).astype(np.uint16 if len(h1) < 1 << 16 else np.int64)
        order = np.argsort(many.astype(np.uint64) << np.uint64(56) | ranges.astype(np.uint64) << np.uint64(32) | tokens)
        order = order[np.argsort(which[order], kind="stable")]
        which, tokens, ranges = which[order], tokens[order], ranges[order]
        first = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        k, at = np.diff(np.append(first, len(which))), sets[which[first]]
        place = np.arange(len(which)) - np.repeat(first, k)
        least, mutual = (np.ceil(share * n[at] - 1e-6).astype(np.int64) - alike[at] for share in (threshold, 2 * threshold / (1 + threshold)))
        taken = place < np.repeat(k - least + 1, k)
        if not taken.any():
            return None
        marks = (place < np.repeat(k - mutual + 1, k))[taken].astype(np.uint8)
        return _cells(ranges[taken], None, np.repeat(sid[at], k)[taken], np.repeat(comp[at], k)[taken], tokens[taken], marks)

    return grouped(["part"], work)


def _crossing(rows: pa.Table) -> pa.RecordBatch | None:
    """The cells of a range of tokens -> (token, sid) of the tokens that are in sets of several clusters, one of them marked."""
    tokens, marks = _joined(rows.column("tokens"), np.uint32), _joined(rows.column("marks"), np.uint8)
    counts = _joined(rows.column("counts"), np.int32)
    sids, comps = (np.repeat(_joined(rows.column(c), np.int64), counts) for c in ("ids", "more"))
    order = np.argsort(tokens)
    tokens, marks, sids, comps = tokens[order], marks[order], sids[order], comps[order]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    cross = (np.minimum.reduceat(comps, starts) != np.maximum.reduceat(comps, starts)) & (np.maximum.reduceat(marks, starts) > 0)
    cross = np.repeat(cross, np.diff(np.append(starts, len(tokens))))
    token = rows.column("part")[0].as_py() << 32 | tokens[cross].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(sids[cross])], names=["token", "sid"])


def _others(docs: DataFrame, sets: DataFrame, clusters: DataFrame, ngram: int, threshold: float, ranges: int) -> DataFrame:
    """(token, sid) by which sets meet that aren't in one cluster: among them a token of every pair at the threshold, without exception."""
    tokens = docs.select("text").mapInArrow(_spread(ngram, ranges), CELL).repartitionById(ranges, "part")
    known = sets.join(clusters, F.col("node") == F.col("sid"), "left").select("h1", "sid", "n", "alike", F.coalesce("comp", "sid").alias("comp"))
    shared = tokens.mapInArrow(_shared(ranges), CELL).unionByName(known.mapInArrow(_known(ranges), CELL)).repartitionById(ranges, "part")
    prefixes = shared.mapInArrow(_prefixes(threshold), CELL).repartitionById(ranges, "part")
    return cut(prefixes.mapInArrow(grouped(["part"], _crossing), "token long, sid long").distinct())


def _links(meeting: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(token, sid) by which sets meet -> links (u, v) that join what may be near."""
    counts = meeting.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    blocks = meeting.join(counts, "token").join(sets.select("sid", "n", "point"), "sid")
    blocks = _tiled(blocks, F.ceil(F.col("m") / TILE_SETS)).select("token", "i", "j", "tile", "sid", "n", "point")
    blocks = blocks.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "sid")
    return blocks.mapInArrow(_block_links(threshold), "u long, v long")


def _tiled(df: DataFrame, tiles: Column) -> DataFrame:
    """Each row with its tile, once for each pair of tiles (i, j) that it takes part in."""
    tile = df.withColumn("tiles", tiles.cast("int")).withColumn("tile", F.pmod(F.xxhash64("sid"), "tiles").cast("int"))
    pairs = tile.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return pairs.select("*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))


def _sets(ngram: int):
    """cluster columns, hashes and text -> the columns and the token set, for rows whose set has those hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, own = _set_hashes(*_tokens(batch.columns[-1], ngram))
            right = np.flatnonzero((h1 == batch.column(0).to_numpy()) & (h2 == batch.column(1).to_numpy()))
            kept = [c.take(pa.array(right)) for c in batch.columns[2:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([own[i].tobytes() for i in right], pa.binary())], names=[*batch.schema.names[2:-1], "tokens"])

    return run


def _hashed(ngram: int):
    """doc_id and text -> the same with the hashes of the token set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, _ = _set_hashes(*_tokens(batch.column(1), ngram))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(h1), pa.array(h2)], names=["doc_id", "text", "h1", "h2"])

    return run


class CountTree:
    """A bulk-loaded R-tree over count vectors; leaves and inner nodes are boxes of FANOUT entries."""

    def __init__(self, points: np.ndarray):
        self.points = points
        spread = np.argsort(-points.var(axis=0))[:3] if len(points) else []
        self.order = np.lexsort(tuple(points[:, d] for d in spread[::-1])) if len(points) else np.zeros(0, np.int64)
        self.levels: list[np.ndarray] = []
        top = points[self.order]
        while len(top) > FANOUT:
            top = np.maximum.reduceat(top, np.arange(0, len(top), FANOUT), axis=0)
            self.levels.append(top)

    def query(self, point: np.ndarray, size: int, sizes: np.ndarray, threshold: float) -> np.ndarray:
        """Entries whose overlap with the point may reach what the threshold asks for; none that does is missed.

        A partner of m tokens needs an overlap of t / (1 + t) * (size + m), and m is at least t * size.
        """
        need = threshold * size
        nodes = np.arange(len(self.levels[-1])) if self.levels else None
        for k in range(len(self.levels) - 1, -1, -1):
            nodes = nodes[np.minimum(self.levels[k][nodes], point).sum(axis=1) >= need - 1e-9]
            below = len(self.levels[k - 1]) if k else len(self.order)
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < below]
        found = self.order if nodes is None else self.order[nodes]
        m = sizes[found]
        fits = (m >= need - 1e-9) & (m * threshold <= size + 1e-9)
        found, m = found[fits], m[fits]
        bound = np.minimum(self.points[found], point).sum(axis=1)
        return found[bound * (1 + threshold) >= threshold * (size + m) - 1e-6]


def near_pairs(sets: list[np.ndarray], threshold: float, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) for all pairs of token sets at the threshold, i < others; only pairs of unlike sides, if sides are given."""
    sizes = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    joined = np.concatenate(sets)
    values = np.unique(joined)
    codes = np.searchsorted(values, joined).astype(np.int32)
    del joined
    points = np.stack([np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)
    tree, mark = CountTree(points), np.zeros(len(values), bool)
    for i in range(len(sets)):
        found = tree.query(points[i], int(sizes[i]), sizes, threshold)
        found = np.sort(found[(found > i) & ((side[found] != side[i]) if side is not None else True)])
        if not len(found):
            continue
        mark[codes[at[i] : at[i + 1]]] = True
        portion = np.cumsum(sizes[found]) // AT_ONCE
        for some in np.split(found, np.flatnonzero(np.diff(portion)) + 1):
            n = sizes[some]
            start = np.concatenate(([0], np.cumsum(n)))
            index = np.arange(start[-1]) + np.repeat(at[some] - start[:-1], n)
            shared = np.add.reduceat(mark[codes[index]], start[:-1], dtype=np.int64)
            good = shared >= threshold * (sizes[i] + n - shared) - 1e-9
            if good.any():
                yield i, some[good]
        mark[codes[at[i] : at[i + 1]]] = False


def _verified(threshold: float):
    """Whole clusters, sorted by cluster and tiles -> a forest of the true links (u, v), and the links that each set has."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        key = [rows.column(c).to_numpy() for c in ("comp", "i", "j")]
        sids, tile, copies = (rows.column(c).to_numpy() for c in ("sid", "tile", "copies"))
        edges = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in key], axis=0), [True])))
        us, vs, links = [], [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            _, once = np.unique(sids[a:b], return_index=True)  # a repeated row comes more than once
            if len(once) < 2:
                continue
            own, side, many = sids[a:b][once], tile[a:b][once], copies[a:b][once]
            tokens = rows.column("tokens").slice(a, b - a).take(pa.array(once)).to_pylist()
            forest, count = Forest(len(once)), np.zeros(len(once), np.int64)
            for i, found in near_pairs([np.frombuffer(t, np.uint64) for t in tokens], threshold, side if key[1][a] != key[2][a] else None):
                count[i] += many[found].sum()
                count[found] += many[i]
                forest.link(i, found)
            u, v = forest.stars()
            has = np.flatnonzero(count)
            us += [own[u], own[has]]
            vs += [own[v], np.full(len(has), -1)]
            links += [np.zeros(len(u), np.int64), count[has]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, links)], names=["u", "v", "links"]) if us else None

    return grouped(["comp", "i", "j"], work)


def _frequent(met: DataFrame) -> bytes:
    """Sorted tokens that are among the first of OFTEN documents or more, over all documents; the FREQUENT most frequent ones.

    They set by which tokens documents meet first, and so how large blocks get and how many pairs are left to the second step.
    """
    counts = met.select(F.explode("lowest").alias("token")).groupBy("token").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(FREQUENT)
    return np.sort(counts.select("token").toArrow()["token"].to_numpy().view(np.uint64)).tobytes()


SET = ["h1", "h2", "n"]


def _near(docs: DataFrame, ngram: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Documents by id and token set; and the sets that aren't empty, each with its least id, its copies, and its links to other sets and class, null if it has none."""
    spark = docs.sparkSession
    small_batches(spark)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    met = cut(docs.mapInArrow(_met(ngram, ranges), "doc_id long, h1 long, h2 long, n int, lowest array<long>, point binary, alike int"))
    sent = spark.sparkContext.broadcast(_frequent(met))
    owners = met.groupBy("doc_id", *SET).agg(F.count("*").alias("times"))
    full = met.where("n > 0").select("lowest", "doc_id", *SET, "point", "alike")
    full = full.mapInArrow(_firsts(sent), "firsts array<long>, doc_id long, h1 long, h2 long, n int, point binary, alike int")
    sets = full.groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("firsts").alias("firsts"), F.first("point").alias("point"), F.first("alike").alias("alike"))
    sets = cut(sets.withColumn("sid", F.monotonically_increasing_id()))
    repeated = owners.where("times > 1").groupBy(*SET).agg(F.sum(F.col("times") - 1).alias("again"))
    if repeated.limit(1).count():
        sets = sets.join(repeated, SET, "left").withColumn("copies", F.col("copies") - F.coalesce("again", F.lit(0))).drop("again")

    clusters = components(_links(sets.select("sid", F.explode("firsts").alias("token")), sets, threshold))
    further = cut(_links(_others(docs, sets, clusters, ngram, threshold, ranges), sets, threshold))
    if further.limit(1).count():
        clusters = components(further.unionByName(clusters.select(F.col("node").alias("u"), F.col("comp").alias("v"))))

    members = clusters.join(sets.select("sid", "rep", "copies", *SET), F.col("node") == F.col("sid"))
    extent = members.groupBy("comp").agg(F.sum("n").alias("tokens"))
    tokens = members.join(extent, "comp").select("h1", "h2", "comp", F.ceil(F.col("tokens") / TILE_TOKENS).alias("tiles"), "sid", "copies", F.col("rep").alias("doc_id"))
    tokens = tokens.join(docs, "doc_id").select("h1", "h2", "comp", "tiles", "sid", "copies", "text")
    tokens = _tiled(tokens.mapInArrow(_sets(ngram), "comp long, tiles long, sid long, copies long, tokens binary"), F.col("tiles"))
    tokens = tokens.select("comp", "i", "j", "tile", "sid", "copies", "tokens").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "sid")
    near = cut(tokens.mapInArrow(_verified(threshold), "u long, v long, links long"))

    links = near.where("v < 0").groupBy(F.col("u").alias("sid")).agg(F.sum("links").alias("links"))
    comps = components(near.where("v >= 0").select("u", "v")).select(F.col("node").alias("sid"), "comp")
    named = sets.select("sid", "rep", "copies", *SET).join(links, "sid", "left").join(comps, "sid", "left")
    return owners, named


def jaccard_classes(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes: (doc_id, class_id, n_links), a row for each document.

    Documents are linked where the Jaccard coefficient of their sets of word n-grams reaches the threshold. A class is what links join, directly
    or through others; class_id is its least doc_id. n_links is the number of documents linked to this one directly, exact
    copies among them. Every document is a query, all its tokens count, nothing is capped, and every pair at the threshold is found; words, n-grams and
    sets are told apart by hashes of 64 bits or more.

    Texts are compared by their lower-cased runs of letters and digits; a text of fewer than `ngram` words is one n-gram. Null and empty
    texts and texts without a word are classes of their own, without links. Null ids have no row. Rows that repeat an id are one document
    for each distinct set of n-grams, with a row each. Ids have to be integers. Other columns are ignored. An empty table gives no rows.
    """
    owners, named = _near(docs, ngram, threshold)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("rep").alias("least"))
    named = named.join(least, "comp", "left").select(*SET, F.coalesce("least", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = owners.select("doc_id", *SET).join(named, SET, "left")
    return known.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each_group(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are the least id of their class of near duplicates; no two that stay are linked.

    Null ids stay, and so do empty texts, each a class of its own. Rows that repeat an id go or stay each by its own text; where texts of one id are
    the least of their class together, those of one set of n-grams stay. An empty table stays empty; all columns are kept, whatever their names.
    """
    key, known = unused(docs, "__gone", "__text")
    owners, named = _near(docs, ngram, threshold)
    least = named.where("comp is not null").groupBy("comp").agg(F.min(F.struct("rep", "h1", "h2")).alias("least"))
    alone, first = F.col("comp").isNull(), F.struct("rep", "h1", "h2") == F.col("least")
    named = named.join(least, "comp", "left").where(alone | first).select(*SET, "rep")
    stays = (F.col("n") == 0) | F.coalesce(F.col("rep") == F.col("doc_id"), F.lit(False))
    marked = owners.select("doc_id", *SET).join(named, SET, "left").select("doc_id", "h1", "h2", stays.alias("stays"))
    ids = cut(marked.groupBy("doc_id").agg(F.max("stays").alias("some"), F.min("stays").alias("all")).where("not all").select("doc_id", "some"))
    left = docs.join(ids.where("not some").select(F.col("doc_id").alias(key)), F.col("doc_id") == F.col(key), "left_anti")
    several = ids.where("some").select("doc_id")
    if several.limit(1).count():  # ids of which some texts go and others stay
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(several, "doc_id", "left_semi").distinct()
        texts = texts.mapInArrow(_hashed(ngram), "doc_id long, text string, h1 long, h2 long")
        gone = texts.join(marked.where("not stays"), ["doc_id", "h1", "h2"]).select(F.col("doc_id").alias(key), F.col("text").alias(known))
        left = left.join(gone, (F.col("doc_id") == F.col(key)) & (F.col("text").cast("string") == F.col(known)), "left_anti")
    return left


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE overlap >= {THRESHOLD} * (x.n + y.n - overlap) - 1e-9
), reach AS (
  SELECT a AS doc_id, a AS b FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.b = e.a
), class AS (SELECT doc_id, min(b) AS class_id FROM reach GROUP BY doc_id),
links AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN class USING (doc_id) LEFT JOIN links USING (doc_id)
"""
