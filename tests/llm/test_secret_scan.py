from __future__ import annotations

import hashlib
import random
import re

import pytest
from setframe.llm import secret_scan

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]+)")


def brute(text: str) -> list[str]:
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)]


def fixture() -> list[tuple]:
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", "=", ": ", '"', "'", " ", "abc12",
             "AKIA", "ABCDEFGHIJKLMNOP12", "0f" * 12, "e", "é", "\n", "😀", "x.y", "passwd=", "ab"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    keys = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
                    for _ in range(44)) for _ in range(40)]
    words = ["aaaa1Aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1A"] * 3
    special = ["", None, "token=secret=abcdef x", "password=token: abcdefgh", "w " * 4000 + "a1" * 12]
    texts = [*made, *(f"see {k} there" for k in keys), *words, *special]
    return [*enumerate(texts), (None, "password=abcdefgh"), (3, texts[3])]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in fixture()],
                                 "doc_id long, text string, spans string, n_hex int")
    return [(r, docs) for r in secret_scan.secrets(docs).collect()]


def test_base_spans_equal_the_patterns(found):
    rows = sorted(fixture(), key=lambda r: (r[0] is None, r[0] or 0))
    got = sorted((r for r, _ in found), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    for (key, text), row in zip(rows, got, strict=True):
        want = brute(text or "")
        assert row.doc_id == key
        base = [s for s in row.spans.split(",") if s and not s.startswith("random")]
        assert base == want, text
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        counts = [sum(s.startswith(k + ":") for s in want) for k in secret_scan.KINDS]
        assert [row.n_assign, row.n_access, row.n_hex] == counts


def test_random_keys_are_added_and_periodic_strings_are_not(found):
    texts = dict(fixture())
    random_rows = {r.doc_id for r, _ in found if "random" in r.spans}
    keys = {i for i, t in texts.items() if t and t.startswith("see ")}
    assert len(keys & random_rows) >= 0.9 * len(keys)
    assert not {i for i, t in texts.items() if t and t.startswith("aaaa1A")} & random_rows


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.secrets(docs).collect() == []


def test_every_class_of_key_is_tested(spark):
    rng = random.Random(9)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    made = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    classes = {
        "upper with digits": lambda: "0189" + made(upper + digits, 36),
        "upper with digits, short": lambda: "8" + made(upper + digits, 19),
        "uuid": lambda: "-".join(made(digits + "abcdef", n) for n in (8, 4, 4, 4, 12)),
        "sk_live": lambda: "sk_live_" + made(lower + digits, 32),
        "lower with digits, short": lambda: "z7" + made(lower + digits, 18),
        "mixed, short": lambda: "zQ7" + made(lower + upper + digits, 17),
        "lower only": lambda: "z" + made(lower, 31),
        "upper only": lambda: "Z" + made(upper, 23),
        "letters only": lambda: "zQ" + made(lower + upper, 22),
        "digits only": lambda: made(digits, 22),
        "base64 with separators": lambda: "x+/9Q_" + made(lower + upper + digits + "-_", 30),
    }
    keys = [(name, make()) for name, make in classes.items() for _ in range(30)]
    words = ["internationalization_of_responses", "-" * 40, "usr/share/documentation/resources",
             "THE_RESTRICTION_OF_ATTENTION_IS_HERE", "heterogeneousDistributionOfStatements",
             "a-b-a-b-a-b-a-b-a-b-a-b-a-b", "0000000000000000000000"]
    texts = [f"see {key} there" for _, key in keys] + [f"see {w} there" for w in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in secret_scan.secrets(docs).collect()}
    for name in classes:
        mine = [i for i, (n, _) in enumerate(keys) if n == name]
        hit = [i for i in mine if rows[i] == f"random:4:{4 + len(keys[i][1])}"]
        assert len(hit) >= 0.8 * len(mine), (name, len(hit))
    assert [w for i, w in enumerate(words, len(keys)) if rows[i]] == []
