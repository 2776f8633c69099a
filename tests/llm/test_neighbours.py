"""Nearest vectors: recall and exact scores against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from setframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, rank int, score double, query_id long, v int, rep int"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 2, 3, 4) for i, v in rows], SCHEMA)


def _usable(v):
    return bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v)


def _brute(rows, every=20, nearest=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([np.float32(v).astype(float) for _, v in rows])
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            scores = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:nearest]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def _clustered(n, d=24, seed=1, norms=True):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    x = centres[rng.integers(40, size=n)] + 0.5 * rng.normal(size=(n, d))
    if norms:
        x *= rng.uniform(0.5, 2.0, size=(n, 1))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def _recall(found, true):
    hits = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in t}) for q, t in true.items())
    return hits / sum(map(len, true.values()))


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 32)
    monkeypatch.setattr(neighbours, "TILE", 300)
    rows = _clustered(4000)
    found, true = _found(neighbours.nearest_vectors(_table(spark, rows))), _brute(rows)
    assert found.keys() == true.keys()
    assert _recall(found, true) >= 0.9
    x = {i: np.float32(v).astype(float) for i, v in rows}
    for q, near in found.items():
        assert len(near) == 20 and q not in dict(near)
        for i, score in near:
            assert score == pytest.approx(float(x[q] @ x[i]), abs=1e-12)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))


def test_all_leaves_is_brute_force(spark, monkeypatch):
    """With every leaf visited the result is exact: ties, copies, odd rows, hot cells."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 8)
    monkeypatch.setattr(neighbours, "TILE", 64)
    rows = _clustered(300, 6)
    rows += [(1000 + i, rows[5][1]) for i in range(150)]
    rows += [(2000 + i, [-x for x in rows[5][1]]) for i in range(30)]
    odd = [(3000, None), (3020, []), (3040, [0.0] * 6), (3060, [None] * 6), (3080, [float("nan")] * 6),
           (3100, [float("inf")] * 6), (3120, [1.0, 2.0]), (None, rows[0][1]), (20, [9.0] * 6)]
    usable = [(i, v) for i, v in rows if _usable(v)]
    found = _found(neighbours.nearest_vectors(_table(spark, rows + odd), recall=1.1))
    true = _brute(usable)
    assert found.keys() == true.keys()
    for q, near in true.items():
        assert [i for i, _ in found[q]] == [i for i, _ in near]
        assert [s for _, s in found[q]] == pytest.approx([s for _, s in near], abs=1e-12)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (7, [1.0, 1.0])]
    assert _found(neighbours.nearest_vectors(_table(spark, rows))) == {
        0: [(7, 1.0), (20, 0.0)], 20: [(7, 1.0), (0, 0.0)]}
    alone = neighbours.nearest_vectors(_table(spark, rows[:1]))
    assert alone.collect() == [] and alone.columns == ["query_id", "rank", "vec_id", "score"]
    assert neighbours.nearest_vectors(_table(spark, [(7, [1.0])])).collect() == []
    assert neighbours.nearest_vectors(_table(spark, rows).limit(0)).collect() == []


def test_visits_are_best_bin_first_and_calibrated():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    norm = float(np.linalg.norm(x, axis=1).max())
    tree = neighbours.fit_tree(x, norm, 100)
    assert 50 <= tree.leaves <= 200
    leaf = tree.place(x)
    assert set(leaf.tolist()) <= set(range(tree.leaves))
    orders = list(tree.visits(x[:50], tree.leaves))
    assert all(sorted(o) == list(range(tree.leaves)) for o in orders)
    # The first leaf is the one a greedy descent of the query reaches; fewer visits are a prefix.
    assert [o[:7] for o in orders] == list(tree.visits(x[:50], 7))
    true = [leaf[np.argsort(-(x @ q))[:10]].tolist() for q in x[:50]]
    visits, reached = neighbours.calibrated_visits(tree, x[:50], true, 0.9)
    share = [np.mean([t in o[:v] for o, ts in zip(orders, true) for t in ts])
             for v in (visits, visits - 1)]
    assert share[0] == pytest.approx(reached) and share[0] >= 0.9 > share[1]
