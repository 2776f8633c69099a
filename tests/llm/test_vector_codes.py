"""Vector codes against complete scans in plain Python."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from setframe.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, id int, v int"


def _plain(rows, rounds=vector_codes.ROUNDS):
    """The definition: every part is compared with every entry in every round."""
    kept = [(i, v, label) for i, v, label in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    limit = vector_codes.LARGEST
    ints = [[max(-limit, min(limit, math.floor(4096 * x))) for x in v] for _, v, _ in kept]
    parts = vector_codes.part_slices(len(ints[0]))
    books = [[v[p] for v in ints[:16]] for p in parts]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        for i, p in enumerate(parts):
            members = {}
            for v in ints:
                members.setdefault(near(v[p], books[i])[1], []).append(v[p])
            for j, found in members.items():
                books[i][j] = [sum(c) // len(found) for c in zip(*found)]
    digest = hashlib.sha256(",".join(str(n) for b in books for e in b for n in e).encode()).hexdigest()
    out, by_label = [], {}
    for (key, _, label), v in zip(kept, ints):
        best = [near(v[p], books[i]) for i, p in enumerate(parts)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        out.append((key, "".join(f"{j:02x}" for _, j in best), error, label))
    return sorted(((k, c, e, by_label[y], digest) for k, c, e, y in out), key=str)


def _rows(n=300, d=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    rows = [(int(i), [float(x) for x in centres[rng.integers(12)] + 0.2 * rng.normal(size=d)],
             None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    # Ties: repeated vectors among the seeds make equal entries; a hot label; negative means.
    rows += [(-5, rows[0][1], 1), (-4, rows[0][1], 1), (-3, [0.0] * d, 1)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(100)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [None] * d, 1), (2003, [float("nan")] * d, 2),
             (2004, [float("inf")] * d, None), (2005, [1.0, 2.0], 1), (None, [0.5] * d, None),
             (1000, rows[4][1], 0), (1000, rows[4][1], 0), (2006, [1e300] * d, 9)]
    return rows


def _table(spark, rows):
    return spark.createDataFrame([(i, v, y, "c", 1, 2, 3) for i, v, y in rows], SCHEMA)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [vector_codes.BLOCK_VALUES, 100])
def test_equals_complete_scans(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", block)
    rows = _rows()
    assert _got(vector_codes.vector_codes(_table(spark, rows))) == _plain(rows)


def test_lengths_that_parts_do_not_divide_and_few_rows(spark):
    for rows in (_rows(40, 11), [(3, [1.0, 2.0, 3.0], 1)], [(3, [0.25] * 8, None), (2, [0.5] * 8, 1)]):
        assert _got(vector_codes.vector_codes(_table(spark, rows))) == _plain(rows)
    none = vector_codes.vector_codes(_table(spark, [(1, None, 1)]).limit(0))
    assert none.collect() == [] and none.columns == [
        "vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_active_entries_equal_a_scan():
    rng = np.random.default_rng(8)
    for trial in range(200):
        vectors = rng.integers(-3, 4, size=(60, 2))
        before = rng.integers(-3, 4, size=(6, 2))
        now = before.copy()
        moved = rng.random(6) < trial % 4 / 3
        now[moved] += rng.integers(-1, 2, size=(int(moved.sum()), 2))
        codes, distances = vector_codes._scan(vectors, before)
        found = vector_codes.reassigned(vectors, codes, distances, before, now)
        for a, b in zip(found, vector_codes._scan(vectors, now), strict=True):
            assert (a == b).all()


def test_fixed_parts_meet_moved_entries_only(monkeypatch):
    vectors = np.arange(20).reshape(10, 2)
    before = np.array([[0, 1], [10, 11], [18, 19]])
    now = before + np.array([[0], [1], [0]])
    codes, distances = vector_codes._scan(vectors, before)
    seen = []
    squares = vector_codes._squares
    monkeypatch.setattr(vector_codes, "_squares",
                        lambda v, e: seen.append((len(v), len(e))) or squares(v, e))
    vector_codes.reassigned(vectors, codes, distances, before, now)
    assert seen == [(int((codes != 1).sum()), 1), (int((codes == 1).sum()), 3)]
