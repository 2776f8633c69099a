from __future__ import annotations

import random

import numpy as np
from setframe.llm import packing


def brute_best_fit(lengths, size):
    room, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [c for c in room if c >= lengths[i]]
        if fits:
            row = max(r for r, c in enumerate(room) if c == min(fits))
        else:
            room.append(size)
            rows.append([])
            row = len(rows) - 1
        rows[row].append(i)
        room[row] -= lengths[i]
    return sorted(sum(lengths[i] for i in r) for r in rows)


def test_tree_packs_like_a_search_over_all_rows():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.randint(4, 40)
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        got = packing.best_fit_decreasing(lengths, size)
        fills = sorted(sum(lengths[i] for i in r) for r in got)
        assert fills == brute_best_fit(lengths, size) and all(f <= size for f in fills)
        assert sorted(i for r in got for i in r) == list(range(len(lengths)))


by_bytes = lambda text: __import__("numpy").frombuffer(text.encode(), "u1").astype("<u4")


def test_rows_restore_every_document(spark):
    rng = random.Random(8)
    texts = ["x" * rng.randint(0, 90) for _ in range(150)] + ["long " * 3000, "", None, "é" * 33]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids array<int>").repartition(3)
    rows = packing.pack(docs, by_bytes, row_tokens=64, end_id=256, buffer_tokens=4000).collect()
    parts = {}
    for r in rows:
        line = np.frombuffer(r.ids, "<u4")
        assert len(line) == 64 and (line[r.n_tokens:] == packing.PAD_ID).all()
        assert r.cu_seqlens[-1] == r.n_tokens
        resets = np.flatnonzero(packing.positions(r.cu_seqlens, 64)[:r.n_tokens] == 0).tolist()
        assert resets == r.cu_seqlens[:-1]
        for doc, place, a, b in zip(r.documents, r.offsets, r.cu_seqlens, r.cu_seqlens[1:],
                                    strict=False):
            parts.setdefault(int(doc), {})[place] = line[a:b].tolist()
    for i, text in enumerate(texts):
        ids = [v for _, piece in sorted(parts[i].items()) for v in piece]
        assert ids == [*by_bytes(text or "").tolist(), 256]


def test_written_rows_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "c")], "doc_id long, text string")
    packed = packing.pack(docs, by_bytes, row_tokens=8, end_id=256)
    packing.write_packed(packed, str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    assert back.agg({"n_tokens": "sum"}).first()[0] == 8
    assert all(r.position_resets == r.cu_seqlens[:-1] for r in back.collect())
    assert packing.described(packing.pack(docs.limit(0), by_bytes)).collect() == []
