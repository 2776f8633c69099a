"""Quality: a byte-level convolutional network in numpy.

A document's bytes, each embedded in a few fixed numbers, pass through learned filters of eight bytes,
four bytes apart. Activations are max-pooled over chunks that overlap and together cover the whole
document; the mean and the maximum over the chunks go into one logistic unit.

The network is trained on a bounded sample of labelled rows (``per_class`` of either class), whole
texts, with Adam; scoring runs where the rows are, a slice of documents at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.llm.columns import fold, labelled_sample
from setframe.session import ship_package

DIMENSIONS, STRIDE, FILTERS = 8, 4, 32
#: Positions (of four bytes) in a block; a chunk is four blocks, and the next starts three later.
BLOCK, CHUNK_BLOCKS, HOP_BLOCKS = 16, 4, 3
BLOCK_BYTES = BLOCK * STRIDE
SLICE_BYTES = 1 << 18
PER_CLASS, EPOCHS, BATCH_BYTES, RATE = 1200, 10, 1 << 17, 0.01


def _embedding() -> np.ndarray:
    """Kind of character, and three pseudo-random codes that tell characters apart."""
    byte = np.arange(256)
    lower, upper = (byte >= 97) & (byte <= 122), (byte >= 65) & (byte <= 90)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    other = (byte > 32) & (byte < 127) & ~lower & ~upper
    codes = np.random.default_rng(7).uniform(-1, 1, (256, 3))
    table = np.column_stack([lower, upper, space, other, byte >= 128, codes])
    table[0] = 0.0
    return table.astype(np.float32)


_EMBEDDED = _embedding()


@dataclass
class Network:
    """``first`` and ``second`` are the filters' halves; ``dense`` holds the weights of the means,
    of the maxima and the constant."""

    first: np.ndarray
    second: np.ndarray
    bias: np.ndarray
    dense: np.ndarray

    def score(self, values: list[bytes]) -> np.ndarray:
        out = np.empty(len(values))
        start = 0
        while start < len(values):
            stop, size = start, 0
            while stop < len(values) and (size < SLICE_BYTES or stop == start):
                size += len(values[stop]) + BLOCK_BYTES
                stop += 1
            out[start:stop] = _sigmoid(self._forward(_Slice(values[start:stop]))[0])
            start = stop
        return out

    def _forward(self, data: _Slice):
        pooled = data.convolve(self.first, self.second)
        hidden = np.maximum(data.over_chunks(pooled) + self.bias, 0.0)
        mean = np.add.reduceat(hidden, data.chunk_start) / data.chunks[:, None]
        most = np.maximum.reduceat(hidden, data.chunk_start)
        features = np.column_stack([mean, most])
        return features @ self.dense[:-1] + self.dense[-1], hidden, features


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class _Slice:
    """Some documents as rows of four embedded bytes, each padded to whole blocks."""

    def __init__(self, values: list[bytes]) -> None:
        blocks = np.array([(len(v) + STRIDE) // BLOCK_BYTES + 1 for v in values])
        first = np.cumsum(blocks) - blocks
        data = np.zeros(int(blocks.sum()) * BLOCK_BYTES + STRIDE, np.uint8)
        for at, value in zip((first * BLOCK_BYTES).tolist(), values, strict=True):
            data[at:at + len(value)] = np.frombuffer(value, np.uint8)
        self.rows = _EMBEDDED[data].reshape(-1, STRIDE * DIMENSIONS)
        self.ends = (first + blocks) * BLOCK - 1
        self.chunks = np.maximum(1, -(-(blocks - 1) // HOP_BLOCKS))
        self.chunk_start = np.cumsum(self.chunks) - self.chunks
        number = np.arange(int(self.chunks.sum())) - np.repeat(self.chunk_start, self.chunks)
        begin = np.repeat(first, self.chunks) + number * HOP_BLOCKS
        self.begin = begin
        self.stop = np.minimum(begin + CHUNK_BLOCKS, np.repeat(first + blocks, self.chunks))

    def convolve(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The filters at every position; a document's last one, all padding, counts for nothing."""
        out = self.rows[:-1] @ first
        out += self.rows[1:] @ second
        out[self.ends] = -1e9
        self.activations = out
        return out.reshape(-1, BLOCK, FILTERS).max(axis=1)

    def over_chunks(self, blocks: np.ndarray) -> np.ndarray:
        padded = np.vstack([blocks, np.full((1, blocks.shape[1]), -1e9, blocks.dtype)])
        edges = np.column_stack([self.begin, self.stop]).ravel()
        return np.maximum.reduceat(padded, edges)[::2]

    def peaks(self, chunks: np.ndarray) -> np.ndarray:
        """The position of each chunk's maximum, by filter."""
        places = self.begin[:, None] * BLOCK + np.arange(CHUNK_BLOCKS * BLOCK)
        inside = places < self.stop[:, None] * BLOCK
        places = np.minimum(places, len(self.activations) - 1)
        values = np.where(inside[:, :, None], self.activations[places], -2e9)
        return np.take_along_axis(places, values.argmax(axis=1), axis=1)


def train(values: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 5,
          prior: float | None = None) -> Network:
    """Fit a network; ``prior`` is the share of label 1 where the sample does not show it.

    Without rows of both classes the score is that share (0.5 without rows).
    """
    rng = np.random.default_rng(seed)
    width = STRIDE * DIMENSIONS
    params = [rng.normal(0, 0.25, (width, FILTERS)).astype(np.float32),
              rng.normal(0, 0.25, (width, FILTERS)).astype(np.float32),
              np.zeros(FILTERS), np.zeros(2 * FILTERS + 1)]
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    if prior is None or not 0 < prior < 1:
        prior = (n[1] + 0.5) / (n.sum() + 1.0)
    params[3][-1] = np.log(prior / (1 - prior))
    if not n.all():
        return Network(*params)
    weight = np.where(y == 1, prior / n[1], (1 - prior) / n[0]) * n.sum()
    moments = [[np.zeros_like(p, float), np.zeros_like(p, float)] for p in params]
    step = 0
    for epoch in range(epochs):
        order, at = rng.permutation(len(values)), 0
        while at < len(order):
            batch, size = [], 0
            while at < len(order) and size < BATCH_BYTES:
                batch.append(order[at])
                size += len(values[order[at]]) + BLOCK_BYTES
                at += 1
            step += 1
            gradients = _gradients(Network(*params), [values[i] for i in batch], y[batch],
                                   weight[batch])
            rate = RATE * (1 - epoch / epochs)
            for k, gradient in enumerate(gradients):
                m, v = moments[k]
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient ** 2 - v)
                update = (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
                params[k] = (params[k] - rate * update).astype(params[k].dtype)
    return Network(*params)


def _gradients(net: Network, values: list[bytes], y: np.ndarray, weight: np.ndarray):
    data = _Slice(values)
    z, hidden, features = net._forward(data)
    dz = (_sigmoid(z) - y) * weight / len(y)
    dense = np.append(features.T @ dz + 1e-4 * net.dense[:-1], dz.sum())
    by_mean = (dz / data.chunks)[:, None] * net.dense[:FILTERS]
    grad = np.repeat(by_mean, data.chunks, axis=0)
    most = np.repeat(features[:, FILTERS:], data.chunks, axis=0)
    # Chunks overlap, so one peak may be the maximum of two: they share its gradient.
    tied = hidden == most
    shares = np.repeat(np.add.reduceat(tied.astype(np.int64), data.chunk_start), data.chunks, axis=0)
    grad += np.where(tied, np.repeat(dz[:, None] * net.dense[FILTERS:-1], data.chunks, axis=0)
                     / np.maximum(shares, 1), 0.0)
    grad *= hidden > 0
    peaks = data.peaks(hidden)
    first, second = np.zeros(net.first.shape), np.zeros(net.second.shape)
    for f in range(FILTERS):
        first[:, f] = grad[:, f] @ data.rows[peaks[:, f]]
        second[:, f] = grad[:, f] @ data.rows[peaks[:, f] + 1]
    return first, second, grad.sum(axis=0), dense


def quality(text: str | Column, net: Network) -> Column:
    """The probability that a text is of quality 1; NULL reads as empty."""
    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        data = [v or b"" for v in values.cast(pa.binary()).to_pylist()]
        return pa.array(net.score(data), pa.float64())
    return score(text)


def trained_on(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0,
               per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text",
               label: str = "quality") -> Network:
    """A network from a bounded sample of the labelled rows outside the held-out fold."""
    ship_package(docs.sparkSession)
    train_rows = fold(key, folds) != held_out
    prior = labels.where(train_rows).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    sample = labelled_sample(docs, labels, key, text, label, train_rows, per_class)
    rows = sample.orderBy(F.xxhash64("t"), "y").toPandas()
    values = [(t or "").encode() for t in rows["t"]]
    return train(values, rows["y"].to_numpy(float), prior=prior)


def scored(docs: DataFrame, net: Network, threshold: float = 0.3, folds: int = 5,
           held_out: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row; other columns are not read.

    Empty and NULL texts are scored as one chunk of padding. There is no shuffle.
    """
    rows = docs.select(F.col(key), quality(text, net).alias("score"))
    return rows.select(key, (fold(key, folds) == held_out).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
