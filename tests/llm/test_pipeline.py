"""The pipeline's stages against plain versions of each, on documents made for it."""

from __future__ import annotations

import hashlib
import math
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from setframe.llm import bpe, mixing, toxicity

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _documents():
    rng = random.Random(17)
    words = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "su") for b in ("ren", "tal", "vis", "dor", "nup")
             for c in ("a", "o", "en", "ix")]
    rows, toxic = [], []

    def add(text, source=None, lang=None, is_toxic=0, key=None):
        key = len(rows) if key is None else key
        rows.append((key, text, lang or rng.choice(["en", "en", "de"]),
                     source or ("hot" if rng.random() < 0.5 else f"s{len(rows) % 4}"), len(text or "")))
        toxic.append((key, 1, is_toxic))

    for i in range(420):
        text = [rng.choice(words) for _ in range(rng.randint(20, 90))]
        bad = i % 5 == 0
        for _ in range(rng.randint(3, 6) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grmblxy", "ZorkIfy", "zork1fied"]))
        add(" ".join(text) + rng.choice(["", "", " | x", " !!"]), is_toxic=int(bad))
    clean = [r for r, t in zip(rows, toxic) if not t[2]]
    for i in range(60):  # exact copies, some in other letter case; near copies
        add(clean[i % 7][1].upper() if i % 3 else clean[i % 7][1])
    for i in range(40):
        copy = clean[20 + i % 6][1].split()
        copy[rng.randrange(len(copy))] = rng.choice(words)
        add(" ".join(copy))
    for text in (None, "", "", " ", "a b", "A b", "wort " * 3000):
        add(text)
    rows += [(None, "kein schluessel hier", None, None, 3), (5, rows[5][1], "en", "s1", 3)]
    return rows, toxic


def _plain_score(lexicon, text):
    text = (text or "").lower().translate(toxicity._TABLE)

    def places(entry):
        at = text.find(entry)
        while at >= 0:
            if not (at and text[at - 1].isalpha()):
                yield at
            at = text.find(entry, at + 1)

    covered = [(s, s + len(p)) for p in lexicon.exceptions for s in places(p)]
    phrases = set(lexicon.exceptions)
    total = sum(w for e, w in lexicon.weights if e not in phrases for s in places(e)
                if not any(a <= s < b for a, b in covered))
    features = (1.0, math.log1p(total), math.log1p(1000.0 * total / (text.count(" ") + 1)))
    z = sum(c * f for c, f in zip(lexicon.curve, features))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _order(key):
    return (key is not None, key or 0)


def _plain_exact(rows):
    """Of equal texts the largest key stays; rows alike in key and text are one."""
    groups = {}
    for r in rows:
        groups.setdefault((r["text"] or "").translate(UPPER), []).append(r)
    return [max(g, key=lambda r: _order(r["doc_id"])) for g in groups.values()]


def _set(text):
    words = (text or "").translate(UPPER).encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def _plain_near(rows):
    """The smallest key of every component of pairs at 0.8 stays."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    sets, root = [_set(r["text"]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i]


def _plain_sampled(rows, mixture):
    def cell(r):
        topic = next((n for n, m in mixing.TOPIC_MARKS if m in (r["text"] or "")), mixing.OTHER_TOPIC)
        return (r["source"] or mixing.NONE, r["lang"] or mixing.NONE, topic)

    count = {}
    for r in rows:
        count[cell(r)] = count.get(cell(r), 0) + len((r["text"] or "").split())
    names = [n for n in count if count[n]]
    tokens = np.array([count[n] for n in names], float)
    weight = tokens / tokens.sum()
    for _ in range(mixture.rounds):
        for d, dimension in enumerate(mixing.DIMENSIONS):
            values = sorted({n[d] for n in names})
            share = np.array([tokens[[n[d] == v for n in names]].sum() for v in values])
            share = share ** mixture.targets[dimension]
            for v, target in zip(values, share / share.sum()):
                at = np.array([n[d] == v for n in names])
                weight[at] *= target / weight[at].sum()
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        low, high = ((level, high) if np.minimum(tokens, level * weight).sum()
                     < mixture.budget * tokens.sum() else (low, level))
    p = dict(zip(names, np.minimum(1.0, high * weight / tokens)))
    kept = []
    for r in rows:
        key = "" if r["doc_id"] is None else r["doc_id"]
        draw = int(hashlib.md5(f"{mixture.seed}:{key}".encode()).hexdigest()[:13], 16) / 2 ** 52
        if draw < p.get(cell(r), 1.0):
            kept.append(r)
    return kept


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that go into each stage, and those that come out."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, marks = _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen, out = [r.asDict() for r in docs.collect()], {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        made = stage(spark, docs, folder)
        made.write.parquet(path)
        assert name == "bpe" or made.columns == docs.columns
        docs = spark.read.parquet(path)
        got = [r.asDict() for r in docs.collect()]
        out[name] = (seen, got)
        seen = got
    return out, folder


def _ids(rows):
    return sorted((r["doc_id"] for r in rows), key=_order)


def test_toxic_documents_go(spark, stages):
    out, folder = stages
    seen, got = out["toxicity"]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    lexicon = toxicity.learned_from(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [r for r in seen if _plain_score(lexicon, r["text"]) < corpus_pipeline.TOXIC]
    assert _ids(got) == _ids(kept)
    scored = {(r.doc_id, r.score) for r in toxicity.scored(documents, lexicon).collect()}
    for r in seen:
        assert any(k == r["doc_id"] and abs(s - _plain_score(lexicon, r["text"])) < 1e-12 for k, s in scored)
    toxic = {k for k, _, y in _documents()[1] if y}
    assert not toxic & {r["doc_id"] for r in got}
    assert {r["doc_id"] for r in seen} - toxic == {r["doc_id"] for r in got}


def test_exact_copies_go(stages):
    seen, got = stages[0]["exact_dedup"]
    assert _ids(got) == _ids(_plain_exact(seen)) and len(got) < len(seen) - 50


def test_near_copies_go(stages):
    seen, got = stages[0]["near_dedup"]
    assert _ids(got) == _ids(_plain_near(seen)) and len(got) < len(seen) - 20


def test_documents_are_sampled(stages):
    seen, got = stages[0]["mixing"]
    assert _ids(got) == _ids(_plain_sampled(seen, corpus_pipeline.MIXTURE))
    assert 0 < len(got) < len(seen)


def test_ids_are_the_library_s(stages):
    seen, got = stages[0]["bpe"]
    with open(public_tokenizers.path(corpus_pipeline.TOKENIZER), "rb") as file:
        ranks = bpe.parse_ranks(file.read())
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in seen:
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    rows = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_run_applies_the_stages(spark, stages):
    out, folder = stages
    rows = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, out["bpe"][1]))


def test_no_documents(spark, tmp_path):
    rows, marks = _documents()
    docs = spark.createDataFrame(rows[:5], "doc_id long, text string, lang string, source string, n_chars long")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").limit(0).write.parquet(
        f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
