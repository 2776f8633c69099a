"""Stored networks: folding batch normalisation, the two layouts of a set, and finding the newest."""

from __future__ import annotations

import time

import numpy as np
import pytest

from setframe.operators import network
from setframe.operators.scoring import Branch, DeepSet, Dense, batch_score


def _dense(rng, n_in, n_out, activation="elu"):
    return Dense(rng.normal(size=(n_in, n_out)), rng.normal(size=n_out), activation)


def _norm(rng, n):
    return network.Normalisation(rng.normal(size=n), rng.uniform(0.1, 2, size=n), rng.normal(size=n),
                                 rng.normal(size=n))


def _model(rng):
    """Two sets, summed over objects and over features, and a vector; the head takes 5 + 3 + 2."""
    return DeepSet(
        (Branch("tracks", 2, 3, (_dense(rng, 2, 4),), (_dense(rng, 4, 5),)),
         Branch("clusters", 4, 3, (_dense(rng, 3, 6), _dense(rng, 6, 4)), (_dense(rng, 4, 3),), True),
         Branch("jets", 2)),
        (_dense(rng, 10, 7), _dense(rng, 7, 6, "softmax")))


def _inputs(rng, n=20):
    tracks, clusters = rng.normal(size=(n, 6)), rng.normal(size=(n, 12))
    tracks[::3, 2::3] = tracks[::4, 1::3] = -999.0  # third and second objects absent
    clusters[::5, 3:6] = -999.0  # the second feature absent in all objects
    return {"tracks": tracks, "clusters": clusters, "jets": rng.normal(size=(n, 2))}


def _plain(model, norms, inputs):
    """Row by row, as the layers are defined."""
    out = []
    for i in range(len(inputs["jets"])):
        merged = []
        for b in model.branches:
            x = inputs[b.column][i]
            if b.max_objects > 1:
                grid = x.reshape(b.n_features, b.max_objects)
                total = 0.0
                for step in (grid if b.by_feature else grid.T):
                    if not (step == -999.0).all():
                        for layer in b.per_object:
                            step = layer(step)
                        total = total + step
                x = total
            for layer in b.dense:
                x = layer(x)
            if b.column in norms:
                n = norms[b.column]
                x = n.gamma * (x - n.mean) / np.sqrt(n.variance + n.epsilon) + n.beta
            merged.append(x)
        x = np.concatenate(merged)
        for layer in model.head:
            x = layer(x)
        out.append(x)
    return np.array(out)


def test_folding_equals_normalising():
    rng = np.random.default_rng(3)
    model, inputs = _model(rng), _inputs(rng)
    for norms in ({}, {"clusters": _norm(rng, 3)},
                  {"tracks": _norm(rng, 5), "clusters": _norm(rng, 3), "jets": _norm(rng, 2)}):
        assert network.folded(model, norms).predict(inputs) == pytest.approx(_plain(model, norms, inputs))


def test_stored_networks(spark, tmp_path):
    rng = np.random.default_rng(4)
    models = [_model(rng), _model(rng)]
    norms = {"tracks": _norm(rng, 5), "jets": _norm(rng, 2)}
    inputs = _inputs(rng)
    for i, model in enumerate(models):
        network.save(spark, model, f"{tmp_path}/run{i}/weights", norms)
        time.sleep(0.05)
    newest = network.load_newest(spark, f"{tmp_path}/*/weights/part-*.parquet")
    want = _plain(models[1], norms, inputs)
    assert newest.predict(inputs) == pytest.approx(want)
    rows = [(i, *(inputs[c][i].tolist() for c in ("tracks", "clusters", "jets"))) for i in range(len(want))]
    table = spark.createDataFrame(rows, "id int, tracks array<double>, clusters array<double>, jets array<double>")
    got = {r.id: r.scores for r in batch_score(table, newest, ["id"]).collect()}
    assert all(got[i] == pytest.approx(want[i]) for i in got) and len(got) == len(want)
    assert network.load(spark, f"{tmp_path}/run0/weights").predict(inputs) == pytest.approx(
        _plain(models[0], norms, inputs))
