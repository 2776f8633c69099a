"""Mixing, vectors and the pipeline: small cases and brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from setframe.llm import embedding_join, mixing

# ---- mixing -------------------------------------------------------------------------------


def _documents(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        source = "hot" if rng.random() < 0.5 else f"s{i % 4}"
        mark = rng.choice(["", "", " | ", "!!"])
        rows.append((i, f"w{mark} " * rng.randint(1, 60), source, rng.choice(["en", "de"]), 0.1, 7))
    rows += [(None, "a b", None, None, 0.0, 1), (3, None, "hot", "en", 0.0, 1), (4, "", "s0", "de", 0.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, "
                                       "p double, tokens long"), rows


def _topic(text):
    return next((n for n, m in mixing.TOPIC_MARKS if m in (text or "")), mixing.OTHER_TOPIC)


def test_probabilities_equal_plain_raking(spark):
    docs, rows = _documents(spark)
    mixture = mixing.Mixture()
    got = mixing.probabilities(docs, mixture).collect()
    assert len(got) == len(rows)
    cells = {}
    for _, text, source, lang, *_ in rows:
        cell = (source or mixing.NONE, lang or mixing.NONE, _topic(text))
        cells[cell] = cells.get(cell, 0) + len((text or "").split())
    names, tokens = list(cells), np.array(list(cells.values()), float)
    weight = tokens / tokens.sum()
    for _ in range(mixture.rounds):
        for d, dimension in enumerate(mixing.DIMENSIONS):
            values = sorted({n[d] for n in names})
            share = np.array([tokens[[n[d] == v for n in names]].sum() for v in values])
            share = share ** mixture.targets[dimension] / (share ** mixture.targets[dimension]).sum()
            for v, target in zip(values, share, strict=True):
                at = np.array([n[d] == v for n in names])
                weight[at] *= target / weight[at].sum()
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        spent = np.minimum(tokens, level * weight).sum()
        low, high = (level, high) if spent < mixture.budget * tokens.sum() else (low, level)
    p = dict(zip(names, np.minimum(1.0, level * weight / tokens), strict=True))
    for r in got:
        cell = (r.source or mixing.NONE, r.lang or mixing.NONE, r.topic)
        assert r.p == pytest.approx(p[cell], abs=1e-6)
        digest = hashlib.md5(f"{mixture.seed}:{'' if r.doc_id is None else r.doc_id}".encode())
        assert r.sampled == (int(digest.hexdigest()[:13], 16) / 2 ** 52 < r.p)
    expected = sum(r.p * r.n_tokens for r in got)
    assert expected == pytest.approx(mixture.budget * tokens.sum(), rel=1e-6)


def test_sampled_rows_keep_their_columns(spark):
    docs, _ = _documents(spark)
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    marked = mixing.probabilities(docs).where("sampled")
    key = lambda v: (v is None, v or 0)
    assert sorted((r.doc_id for r in kept.collect()), key=key) == sorted(
        (r.doc_id for r in marked.collect()), key=key)
    assert mixing.sampled(docs.limit(0)).collect() == []
    fixed = mixing.Mixture(targets={"source": {"hot": 0.2, "s1": 0.8}, "lang": 1.0, "topic": 1.0})
    assert {r.source for r in mixing.probabilities(docs, fixed).where("sampled and n_tokens > 0")
            .select("source").distinct().collect()} == {"hot", "s1"}


def test_marginals_tell_what_was_reached(spark):
    docs, _ = _documents(spark)
    assert mixing.marginals(docs).agg({"error": "max"}).first()[0] < 0.01
    rows = [(i, "w " * 10, f"s{i % 3}", f"l{i % 3}") for i in range(90)]
    own = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    apart = mixing.Mixture(targets={"source": {"s0": 0.5, "s1": 0.3, "s2": 0.2},
                                    "lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}, "topic": 1.0})
    got = {(r.dimension, r.value): r for r in mixing.marginals(own, apart).collect()}
    assert got["source", "s0"].target == pytest.approx(0.5) and got["source", "s0"].error > 0.2
    assert got["lang", "l0"].error < 1e-9


def test_topics_may_be_a_column(spark):
    docs, _ = _documents(spark)
    marked = docs.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "even"))
    rows = mixing.probabilities(marked, mixing.Mixture(topic=F.col("kind"))).collect()
    assert {r.topic for r in rows} == {"even", mixing.NONE} and len(rows) == docs.count()
    shares = mixing.Mixture(topic=F.col("kind"), targets={"source": 1.0, "lang": 1.0, "topic": {"even": 1.0}})
    kept = mixing.sampled(marked, shares)
    assert kept.columns == marked.columns and kept.where("kind is null and text <> ''").count() == 0


# ---- vectors ------------------------------------------------------------------------------

def _vectors():
    rng = np.random.default_rng(4)
    rows = []
    for centre in rng.normal(size=(25, 16)):
        for _ in range(rng.integers(1, 12)):
            near = centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.25])
            rows.append(([float(np.float32(v)) for v in near], int(rng.integers(0, 2))))
    rows += [([0.0] * 16, 0), (None, 0), ([1.0, None] * 8, 1), ([float("nan")] * 16, 1), ([], 0),
             (rows[0][0], None), ([float("inf")] + [1.0] * 15, 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def _usable(v, label):
    return (label is not None and bool(v) and None not in v and bool(np.isfinite(v).all())
            and np.linalg.norm(v) > 0)


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "TILE", 16)
    rows = _vectors()
    table = spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows],
                                  "vec_id long, embedding array<float>, label int, n int, id string")
    got = {r.vec_id: r for r in embedding_join.near_vectors(table).collect()}
    assert len(got) == len(rows)
    links = {i: set() for i, _, _ in rows}
    for a, x, y in rows:
        for b, z, w in rows:
            if a != b and y == w and _usable(x, y) and _usable(z, w) and len(x) == len(z):
                x32, z32 = np.float32(x).astype(float), np.float32(z).astype(float)
                if x32 @ z32 / (np.linalg.norm(x32) * np.linalg.norm(z32)) >= 0.93:
                    links[a].add(b)
    for i in links:
        reach, queue = {i}, [i]
        while queue:
            queue += [j for j in links[queue.pop()] if j not in reach and not reach.add(j)]
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (
            len(links[i]), min(reach), min(reach) == i)


def test_repeated_vectors_and_no_vectors(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    table = spark.createDataFrame([(5, one, 1), (5, one, 1), (7, one, 1), (None, one, 1), (8, one, 2)],
                                  "vec_id long, embedding array<float>, label int")
    rows = sorted((tuple(r) for r in embedding_join.near_vectors(table).collect()), key=str)
    assert rows == sorted([(5, 3, 5, True), (5, 3, 5, True), (7, 3, 5, False), (None, 3, 5, False),
                           (8, 0, 8, True)], key=str)
    assert embedding_join.near_vectors(table.limit(0)).collect() == []


def _results(table):
    return sorted((tuple(r) for r in embedding_join.near_vectors(table).collect()), key=str)


def test_vectors_with_one_digest(spark, monkeypatch):
    """Where digests are shared, the vectors themselves tell whose links are whose."""
    table = spark.createDataFrame(_vectors() + _vectors()[:9], "vec_id long, embedding array<double>, label int")
    want = _results(table)
    monkeypatch.setattr(embedding_join, "_digest", lambda label, vector: F.lit(0).cast("bigint"))
    assert _results(table) == want


def test_a_vector_travels_once_for_each_chunk_of_its_label(spark, monkeypatch):
    """Neither blocks nor cells send a vector anywhere."""
    monkeypatch.setattr(embedding_join, "TILE", 100)
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, 8, [float(v) for v in rng.normal(size=8)], 1) for i in range(600)]
    reps = spark.createDataFrame(rows, "id long, label int, d int, e array<double>, n long")
    reps = reps.withColumn("mark", F.xxhash64("id"))
    tiles = embedding_join._tiles(reps).collect()
    assert len(tiles) == 3 * 600  # three chunks a label
    assert len({(r.label, r.first, r.second) for r in tiles}) == 2 * 6


@pytest.mark.parametrize("spread", [0.0, 0.02, 0.15, 1.0])
@pytest.mark.parametrize("pairs", [7, 16_384])
def test_tile_equals_brute_force(monkeypatch, spread, pairs):
    """Leaves that are looked up and leaves that are multiplied out, one chunk and two."""
    monkeypatch.setattr(embedding_join, "LEAF", 5)
    monkeypatch.setattr(embedding_join, "PAIRS", pairs)
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.normal(size=(8, 20)), 40, axis=0) + spread * rng.normal(size=(320, 20))
    vectors = rng.permutation(vectors) * rng.uniform(0.1, 9, size=(320, 1))
    copies, n = rng.integers(1, 4, size=320), 320
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.93) & ~np.eye(n, dtype=bool)
    own, other = np.arange(0, n, 2), np.arange(1, n, 2)
    for a, b, among in ((np.arange(n), np.arange(n), np.ones((n, n), bool)),
                        (own, other, np.add.outer(np.arange(n), np.arange(n)) % 2 == 1)):
        tile = embedding_join._Tile(vectors, copies, 0.93)
        tile.join(a, b, a is b or len(a) == n)
        links = linked & among
        assert tile.count.tolist() == (links @ copies).tolist()
        reach = np.eye(n, dtype=bool) | links
        for _ in range(9):
            reach = reach @ reach
        assert tile.root.tolist() == reach.argmax(axis=1).tolist()


# ---- pipeline -----------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf_dir, docs = "/root/testdata/sf0.001", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= seen
        seen = docs.count()
        assert name == "bpe" or docs.columns == columns
    assert sorted(map(tuple, docs.collect())) == sorted(
        map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
