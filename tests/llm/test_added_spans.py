"""Precision and recall of the spans that the field adds, on planted entities that the patterns miss."""

from __future__ import annotations

import random

from setframe.llm import pii

WORDS = "the order was sent to our office last week and they asked for more details about it".split()


def _luhn_card(rng):
    digits = [4, *(rng.randrange(10) for _ in range(14))]
    for last in range(10):
        if pii.luhn("".join(map(str, [*digits, last]))):
            return "".join(map(str, [*digits, last]))


def _entity(rng):
    """``(kind, text)`` of an entity in a form that no base pattern matches."""
    kind = rng.randrange(3)
    name, host = rng.choice(["bob", "ann.lee", "j_doe7"]), rng.choice(["example", "mail-box", "3com"])
    if kind == 0:
        at, dot = rng.choice(["(at)", " (at) ", "[at]", " [AT] "]), rng.choice(["(dot)", " (dot) ", "[dot]", "."])
        return 0, f"{name}{at}{host}{dot}com"
    if kind == 1:
        card = _luhn_card(rng)
        return 2, ".".join(card[i:i + 4] for i in range(0, 16, 4))
    a, b, c = rng.randrange(200, 999), rng.randrange(200, 999), rng.randrange(1000, 9999)
    return 3, rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])


LEAD = {0: ("mail", "contact", "write"), 2: ("card", "visa"), 3: ("phone", "tel", "call")}
DECOYS = ("2024-11-05", "order 123456789", "12:30:45", "version 1.2.3", "pages 100-200", "10,000.50", "#4821",
          "size 1024x768", "(2019)", "price 4.99", "A1-B2-C3", "at 5.30 on 12/11/2023")


def _planted(seed, n=600):
    rng = random.Random(seed)
    for _ in range(n):
        parts, truth, at = [], set(), 0

        def add(text):
            nonlocal at
            parts.append(text)
            at += len(text) + 1

        for _ in range(rng.randint(2, 5)):
            for _ in range(rng.randint(2, 6)):
                add(rng.choice(WORDS))
            if rng.random() < 0.5:
                add(rng.choice(DECOYS))
            else:
                kind, text = _entity(rng)
                add(rng.choice(LEAD[kind]) + rng.choice(["", ":"]))
                truth.add((at, kind, at + len(text)))
                add(text)
        add("thanks")
        yield " ".join(parts), truth


def test_precision_and_recall_of_added_spans():
    sample = ["write to a.b@c.de or +1 (244) 555-4688 or 10.0.0.1 or 4111 1111 1111 1111", "x 2024 at 5.30",
              "order 123456789 of 12/11/2023"] * 20
    weights = pii.fit(sample)
    right = added = planted = 0
    for text, truth in _planted(1):
        base, every = pii.all_spans(text, weights)
        mine = set(every) - set(base)
        right += len(mine & truth)
        added += len(mine)
        planted += len(truth - set(base))
    assert planted > 800
    print("precision", right / added, "recall", right / planted)
    assert right / added >= 0.95 and right / planted >= 0.9
