"""Very long texts: results stay right and time grows with the length, not with its square."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
from setframe.llm import pii, secret_scan, toxicity


def test_long_digit_runs_are_rows():
    text = "0" * 5000 + ".1.2.3 and " + "9" * 6000 + ".1.2.3"
    assert pii.base_spans(text) == [(0, 1, 5006)]
    start = time.perf_counter()
    assert [s for s in pii.base_spans("7" * 1_000_000) if s[1] == 1] == []
    assert time.perf_counter() - start < 20


def test_personal_data_in_a_long_text():
    one = "ask bob@example.com or 10.0.0.1, phone (244) 555-4688 and x (at) y (dot) com. "
    weights = pii.fit([one] * 5)
    few, many = (pii.all_spans(one * n, weights) for n in (10, 10_000))
    assert len(many[0]) == 1000 * len(few[0]) and len(many[1]) == 1000 * len(few[1])
    seconds = []
    for n in (4000, 16_000):
        start = time.perf_counter()
        pii.all_spans(one * n, weights)
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 10 * seconds[0] + 1


def test_touching_spans_are_left_out_as_by_comparing_all():
    rng = random.Random(6)
    parts = ["a@b.de", " ", "+1 (22) 33-4455", "4111 1111 1111 1111", "1.2.3.4", "7", "-", "(at)", "x.y", "244-555-4688"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        base, every = pii.all_spans(text, pii.PRIOR)
        extra = []
        for start, stop in pii.islands(text):
            edges, found = pii.candidates(text, start, stop)
            extra += [s for s in pii.decode(edges, found, pii.PRIOR)
                      if not any(s[0] < b[2] and b[0] < s[2] for b in base)]
        assert every == sorted(base + extra), text


def test_many_matches_and_phrases():
    lexicon = toxicity.Lexicon((("stupid", 3.0), ("awful", 2.0)), ("not stupid", "so awful"), (-2.0, 3.0, 0.5))
    rng = random.Random(1)
    text = " ".join(rng.choice(["stupid", "not stupid", "so awful", "awful", "fine"]) for _ in range(100_000))
    start = time.perf_counter()
    found = lexicon.matches(text)
    assert time.perf_counter() - start < 20
    harmless = text.count("not stupid") + text.count("so awful")
    assert len(found) == text.count("stupid") + text.count("awful") - harmless


def test_matches_outside_phrases_equal_comparing_all():
    rng = random.Random(3)
    for _ in range(500):
        found = [(rng.randrange(60), "e") for _ in range(rng.randrange(12))]
        covered = [(a, a + rng.randrange(15)) for a in (rng.randrange(60) for _ in range(rng.randrange(6)))]
        want = sorted((s, e) for s, e in found if not any(a <= s <= b for a, b in covered))
        assert toxicity._outside(found, covered) == want


def test_secrets_in_long_texts(spark):
    rng = np.random.default_rng(1)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    blob = "".join(rng.choice(letters, 300_000))
    many = "token=abcdef12 " * 20_000
    docs = spark.createDataFrame([(1, f"see {blob} there"), (2, many)], "doc_id long, text string")
    start = time.perf_counter()
    rows = {r.doc_id: r for r in secret_scan.secrets(docs).collect()}
    assert time.perf_counter() - start < 120
    assert f"random:4:{4 + len(blob)}" in rows[1].spans.split(",")
    spans = [f"assign:{15 * i}:{15 * i + 14}" for i in range(20_000)]
    assert rows[2].n_assign == 20_000
    assert rows[2].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
