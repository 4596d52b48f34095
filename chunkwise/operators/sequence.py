"""Numeric operators on sequences: within an array as higher-order functions, along rows as windows, and the recurrent scan with carried state."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-5


def _doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once for a row and not once for each element of a fold."""
    return F.transform(F.array(value), body)[0]


def _share(x: Column) -> Column:
    return _let(_sum(x), lambda s: F.transform(x, lambda v: v / s))


def softmax(x: Column, clip: float | None = None) -> Column:
    """Of an array, shifted by its greatest number. With clip, no share is below it before a second normalisation."""
    e = lambda d: _let(F.array_max(d), lambda top: F.transform(d, lambda v: F.exp(v - top)))
    p = lambda d: _let(e(d), _share)
    if clip is None:
        return _let(_doubles(x), p)
    return _let(_doubles(x), lambda d: _let(F.transform(p(d), lambda v: F.greatest(v, F.lit(clip))), _share))


def layer_norm(x: Column, gain: float = 1.0, bias: float = 0.0, epsilon: float = EPSILON) -> Column:
    """(x - mean) / sqrt(population variance + epsilon), times gain, plus bias."""
    scaled = lambda d: _let(F.sqrt(_sum(F.transform(d, lambda v: v * v)) / F.size(d) + epsilon), lambda s: F.transform(d, lambda v: v / s * gain + bias))
    return _let(_doubles(x), lambda d: _let(_let(_sum(d) / F.size(d), lambda m: F.transform(d, lambda v: v - m)), scaled))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu_squared(x: Column) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), 2)


def dot(a: Column, b: Column) -> Column:
    """In order, so the sum doesn't hang on how rows are dealt out."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


def matvec(x: Column, weights: list[list[float]]) -> Column:
    """weights: an output's row of coefficients each. The matrix is a constant of the plan."""
    return F.transform(matrix(weights), lambda w: dot(x, w))


def matvec3(x: Column, k: list[list[float]], v: list[list[float]], r: list[list[float]]) -> tuple[Column, Column, Column]:
    """Three products of one pass over the rows."""
    return matvec(x, k), matvec(x, v), matvec(x, r)


def matmul_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, j, value) of the product of sparse matrices (i, k, x) and (k, j, w)."""
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("w")).alias("value"))


def lookup(tokens: DataFrame, embeddings: DataFrame, token: str, key: str) -> DataFrame:
    """Rows of the table for each token; tokens without one keep nulls. Broadcast only where statistics or AQE find the table small."""
    return tokens.join(embeddings, F.col(token) == F.col(key), "left")


def premix(rows: DataFrame, group: list[str], order: list[str], x: str, shares: dict[str, float], initial: float = 0.0) -> DataFrame:
    """x * share + previous * (1 - share) for each share, named after it. Before the first comes `initial`."""
    previous = F.lag(x, 1, initial).over(Window.partitionBy(*group).orderBy(*order))
    rows = rows.withColumn("__previous", previous)
    return rows.withColumns({name: F.col(x) * s + F.col("__previous") * (1 - s) for name, s in shares.items()}).drop("__previous")


def wkv_step(state: tuple[float, float, float], k: float, v: float, w: float, u: float) -> tuple[float, tuple[float, float, float]]:
    """Output and next state of the recurrence; (aa, bb, pp) is kept relative to the greatest exponent."""
    aa, bb, pp = state
    p = max(pp, u + k)
    a, b = math.exp(pp - p), math.exp(u + k - p)
    y = (a * aa + b * v) / (a * bb + b)
    p = max(w + pp, k)
    a, b = math.exp(w + pp - p), math.exp(k - p)
    return y, (a * aa + b * v, a * bb + b, p)


FRESH = (0.0, 0.0, -1e30)


def wkv_run(k: np.ndarray, v: np.ndarray, w, u, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence along the first axis at once: outputs and the next state. k, v: (n, channels); state: (aa, bb, pp) for each channel.

    What has been added up before a step is a sum of exponentials, which logaddexp accumulates; positive and negative values apart.
    """
    n = len(k)
    away = -w * np.arange(n)[:, None]
    aa, bb, pp = state
    with np.errstate(divide="ignore"):
        first = [np.log(np.maximum(aa, 0)) + pp, np.log(np.maximum(-aa, 0)) + pp, np.log(bb) + pp]
        terms = [k + away + np.log(np.maximum(v, 0)), k + away + np.log(np.maximum(-v, 0)), k + away]
    since = w * (np.arange(n + 1)[:, None] - 1)
    plus, minus, below = (np.logaddexp.accumulate(np.concatenate(((f + w)[None], t)), axis=0) + since for f, t in zip(first, terms))
    top = np.maximum(below[:-1], u + k)
    own = np.exp(u + k - top)
    y = (np.exp(plus[:-1] - top) - np.exp(minus[:-1] - top) + own * v) / (np.exp(below[:-1] - top) + own)
    return y, np.stack((np.exp(plus[-1] - below[-1]) - np.exp(minus[-1] - below[-1]), np.ones_like(bb), below[-1]))


def fresh(channels: int) -> np.ndarray:
    return np.repeat(np.array(FRESH)[:, None], channels, axis=1)


def _along(rows: DataFrame, group: str, order: list[str], columns: list[Column], start, step, output: str) -> DataFrame:
    """(group, position, y): step(values, state) -> (outputs, state) along each group, as it streams by in order.

    values are the columns of a run of rows of one group within a batch. State is carried from batch to batch, so a group of any length takes
    constant memory. group is a column of whole numbers; null groups are left out.
    """

    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, position = None, start(), 0
        for batch in batches:
            g = batch.column(0).to_numpy()
            values = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(g), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns[1 : 1 + n]]
            edges = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True]))) if len(g) else [0]
            ys, at = [], np.empty(len(g), np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                if g[a] != last:
                    last, state, position = g[a], start(), 0
                y, state = step([x[a:b] for x in values], state)
                ys.append(y)
                at[a:b] = position + np.arange(b - a)
                position += b - a
            if ys:
                y = np.concatenate(ys)
                out = pa.array(y) if y.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), out], names=["grp", "position", "y"])

    own = rows.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("grp"), *(c.alias(f"x{i}") for i, c in enumerate(columns)), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)))
    sort = ["grp", *(f"o{i}" for i in range(len(order)))]
    return own.repartition("grp").sortWithinPartitions(*sort).mapInArrow(run, f"grp long, position long, y {output}").withColumnRenamed("grp", group)


def _number(c: str) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast("double")


def wkv_scan(rows: DataFrame, group: str, order: list[str], k: str, v: str, w: float = -0.05, u: float = 0.3) -> DataFrame:
    """(group, position, y): the recurrence along each group."""

    def step(values, state):
        y, state = wkv_run(values[0][:, None], values[1][:, None], w, u, state)
        return y[:, 0], state

    return _along(rows, group, order, [_number(k), _number(v)], lambda: fresh(1), step, "double")


def wkv_fold(ks: Column, vs: Column, w: float = -0.05, u: float = 0.3) -> Column:
    """The recurrence within arrays, without Python: an array of outputs."""
    start = F.struct(F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"), F.lit(-1e30).alias("pp"), F.array().cast("array<double>").alias("ys"))

    def step(acc, kv):
        k, v = kv["k"].cast("double"), kv["v"].cast("double")
        p, q = F.greatest(acc["pp"], u + k), F.greatest(w + acc["pp"], k)
        a, b = F.exp(acc["pp"] - p), F.exp(u + k - p)
        c, d = F.exp(w + acc["pp"] - q), F.exp(k - q)
        y = (a * acc["aa"] + b * v) / (a * acc["bb"] + b)
        return F.struct((c * acc["aa"] + d * v).alias("aa"), (c * acc["bb"] + d).alias("bb"), q.alias("pp"), F.concat(acc["ys"], F.array(y)).alias("ys"))

    return F.aggregate(F.zip_with(ks, vs, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), start, step)["ys"]


def rank_of(x: Column, index: Column) -> Column:
    """Rank, from 1, of the number at an index among the array; of equal numbers the lower index is ahead."""
    own = F.element_at(x, index.cast("int") + 1)
    ahead = F.filter(x, lambda v, i: (v > own) | ((v == own) & (i < index)))
    return F.size(ahead) + 1


def hit_rates(ranked: DataFrame, rank: str, ks: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(k, hit_rate): the share of rows whose rank is at most k."""
    sums = ranked.agg(*(F.avg((F.col(rank) <= k).cast("double")).alias(f"k{k}") for k in ks))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("hit_rate")) for k in ks))).alias("r")).select("r.*")


def quantize(x: Column) -> dict[str, Column]:
    """Eight bits for each number of an array: offset is the least, scale a 255th of the spread (1e-12 at least)."""
    scale_of = lambda d: F.greatest((F.array_max(d) - F.array_min(d)) / 255, F.lit(1e-12))
    level = lambda v, low, scale: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v - low) / scale + 0.5).cast("int")))
    each = lambda f: _let(_doubles(x), lambda d: _let(F.array_min(d), lambda low: _let(scale_of(d), lambda scale: F.transform(d, lambda v: f(v, low, scale)))))
    norm = lambda d: F.sqrt(_sum(F.transform(d, lambda v: v * v)) / F.size(d))
    back = each(lambda v, low, scale: level(v, low, scale) * scale + low)
    error = _let(F.zip_with(_doubles(x), back, lambda a, b: a - b), norm)
    return {"scale": scale_of(_doubles(x)), "offset": F.array_min(_doubles(x)), "q": each(level), "dequantized": back, "rel_rmse": error / (_let(_doubles(x), norm) + 1e-12)}


def snapped(x: Column, scale: float) -> Column:
    """Rounded to a grid of 1 / scale, halves up."""
    return F.floor(x * scale + 0.5) / scale


def _shifted(x: np.ndarray, before) -> np.ndarray:
    return np.concatenate((np.reshape(before, (1, *x.shape[1:])), x[:-1]))


def _sig(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def layer_step(rows: DataFrame, group: str, order: list[str], x: str, w: float = -0.05, u: float = 0.3, mix: tuple[float, float, float] = (0.3, 0.5, 0.8)) -> DataFrame:
    """One layer along each group for a single channel: mix with the previous, scan, gate, add; then mix, relu squared, gate, add. (group, position, y)."""

    def step(values, state):
        (v,), (scan, xx, ff) = values, state
        before = _shifted(v, xx)
        k_, v_, r_ = (v * m + before * (1 - m) for m in mix)
        y, scan = wkv_run(k_[:, None], v_[:, None], w, u, scan)
        h = v + _sig(r_) * y[:, 0]
        before = _shifted(h, ff)
        fk, fr = (h * m + before * (1 - m) for m in (mix[0], mix[2]))
        return h + _sig(fr) * np.maximum(fk, 0.0) ** 2, (scan, v[-1], h[-1])

    return _along(rows, group, order, [_number(x)], lambda: (fresh(1), 0.0, 0.0), step, "double")


@dataclass(frozen=True)
class Layer:
    """Weights of a layer of C channels: shares of the present in each mix, decay and bonus by channel, products (rows are outputs)."""

    mix_k: np.ndarray
    mix_v: np.ndarray
    mix_r: np.ndarray
    decay: np.ndarray
    bonus: np.ndarray
    key: np.ndarray
    value: np.ndarray
    gate: np.ndarray
    out: np.ndarray
    wide: np.ndarray
    narrow: np.ndarray
    gate2: np.ndarray
    epsilon: float = EPSILON

    @staticmethod
    def of(channels: int, widening: int = 2) -> Layer:
        """Small fixed weights."""
        m = lambda rows, columns, seed: ((np.arange(rows)[:, None] * 13 + np.arange(columns) * 7 + seed) % 11 - 5) / 10.0
        share = lambda seed: 0.2 + 0.6 * ((np.arange(channels) * 3 + seed) % 5) / 4
        c, f = channels, channels * widening
        return Layer(share(0), share(1), share(2), -0.05 - 0.01 * np.arange(c), 0.3 + 0.05 * np.arange(c), m(c, c, 1), m(c, c, 2), m(c, c, 3), m(c, c, 4), m(f, c, 5), m(c, f, 6), m(c, c, 7))

    def norm(self, x: np.ndarray) -> np.ndarray:
        d = x - x.mean(axis=1, keepdims=True)
        return d / np.sqrt((d * d).mean(axis=1, keepdims=True) + self.epsilon)

    def start(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return fresh(len(self.decay)), np.zeros(len(self.decay)), np.zeros(len(self.decay))

    def run(self, x: np.ndarray, state: tuple) -> tuple[np.ndarray, tuple]:
        """Outputs for a run of positions (rows), and the next state: a norm, mixes, products, recurrence and gate, added; then the same for the wide products."""
        scan, before, before2 = state
        h = self.norm(x)
        past = _shifted(h, before)
        k, v, r = ((h * m + past * (1 - m)) @ p.T for m, p in ((self.mix_k, self.key), (self.mix_v, self.value), (self.mix_r, self.gate)))
        y, scan = wkv_run(k, v, self.decay, self.bonus, scan)
        x = x + (_sig(r) * y) @ self.out.T
        h2 = self.norm(x)
        past = _shifted(h2, before2)
        k2, r2 = h2 * self.mix_k + past * (1 - self.mix_k), h2 * self.mix_r + past * (1 - self.mix_r)
        x = x + _sig(r2 @ self.gate2.T) * (np.maximum(k2 @ self.wide.T, 0) ** 2 @ self.narrow.T)
        return x, (scan, h[-1], h2[-1])


def layer(rows: DataFrame, group: str, order: list[str], x: str, weights: Layer) -> DataFrame:
    """(group, position, y): a whole layer along each group; x and y are arrays of as many numbers as the layer has channels."""
    return _along(rows, group, order, [F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))], weights.start, lambda values, state: weights.run(values[0], state), "array<double>")


def quantized_weights(weights: list[list[float]]) -> list[list[float]]:
    """A matrix as eight-bit numbers and back, with a scale and an offset for each input channel (column)."""
    m = np.array(weights, np.float64)
    low, scale = m.min(axis=0), np.maximum((m.max(axis=0) - m.min(axis=0)) / 255, 1e-12)
    return (np.clip(np.floor((m - low) / scale + 0.5), 0, 255) * scale + low).tolist()
