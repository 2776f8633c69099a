"""The convolutional network against a plain convolution and a numerical gradient."""

from __future__ import annotations

import random

import numpy as np
import pytest
from setframe.llm import quality


def _network(seed):
    rng = np.random.default_rng(seed)
    width = quality.STRIDE * quality.DIMENSIONS
    return quality.Network(rng.normal(0, 0.3, (width, quality.FILTERS)),
                           rng.normal(0, 0.3, (width, quality.FILTERS)),
                           rng.normal(0, 0.2, quality.FILTERS), rng.normal(0, 0.5, 2 * quality.FILTERS + 1))


def _texts(seed):
    rng = random.Random(seed)
    sizes = [0, 1, 3, 4, 5, 59, 60, 61, 63, 64, 65, 130, 255, 256, 257, 1000, 20_000]
    return [bytes(rng.randrange(1, 256) for _ in range(n)) for n in sizes]


def _plain(net, value):
    """One document, one filter position at a time."""
    step, d = quality.STRIDE, quality.DIMENSIONS
    blocks = (len(value) + step) // quality.BLOCK_BYTES + 1
    padded = value + b"\0" * (blocks * quality.BLOCK_BYTES - len(value))
    rows = [np.concatenate([quality._EMBEDDED[b] for b in padded[i:i + step]]) for i in range(0, len(padded), step)]
    assert all(len(r) == step * d for r in rows)
    maxima = []
    for block in range(blocks):
        places = [p for p in range(block * quality.BLOCK, (block + 1) * quality.BLOCK) if p + 1 < len(rows)]
        maxima.append(np.max([rows[p] @ net.first + rows[p + 1] @ net.second for p in places], axis=0))
    chunks, start = [], 0
    while True:
        chunk = maxima[start:start + quality.CHUNK_BLOCKS]
        chunks.append(np.maximum(np.max(chunk, axis=0) + net.bias, 0.0))
        if start + quality.CHUNK_BLOCKS >= blocks:
            break
        start += quality.HOP_BLOCKS
    features = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
    return 1.0 / (1.0 + np.exp(-np.clip(features @ net.dense[:-1] + net.dense[-1], -30, 30)))


def test_scores_equal_a_plain_convolution(monkeypatch):
    net, values = _network(1), _texts(2)
    want = [_plain(net, v) for v in values]
    assert net.score(values) == pytest.approx(want, abs=1e-6)
    monkeypatch.setattr(quality, "SLICE_BYTES", 300)
    assert net.score(values) == pytest.approx(want, abs=1e-6)
    assert net.score(values[::-1]) == pytest.approx(want[::-1], abs=1e-6)


def test_gradients_are_numerical_ones():
    net, values = _network(3), _texts(4)[:-1]
    y = np.array([i % 2 for i in range(len(values))], float)
    weight = np.linspace(0.5, 2.0, len(values))

    def loss(n):
        p = n.score(values)
        return (float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).sum()) / len(y)
                + 0.5e-4 * float((n.dense[:-1] ** 2).sum()))

    found = quality._gradients(net, values, y, weight)
    rng = np.random.default_rng(5)
    for name, gradient in zip(("first", "second", "bias", "dense"), found, strict=True):
        param = getattr(net, name)
        for at in [tuple(rng.integers(s) for s in param.shape) for _ in range(25)]:
            kept, slopes = param[at], []
            for step in (1e-5, -1e-5):
                param[at] = kept + step
                slopes.append(loss(net))
            param[at] = kept
            assert gradient[at] == pytest.approx((slopes[0] - slopes[1]) / 2e-5, rel=1e-3, abs=1e-6), (name, at)


def test_very_long_text_is_one_of_many():
    net = _network(6)
    long = b"lorem ipsum dolor " * 60_000
    alone = net.score([long])[0]
    assert net.score([b"a", long, b"", long + b"\xff" * 3])[1] == pytest.approx(alone)
