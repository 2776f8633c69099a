"""Source divergence against a plain evaluation of every group with every kept term."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from setframe.llm import divergence

SCHEMA = ("doc_id long, text string, lang string, source string, term string, n int, p double, "
          "copies string, digest string")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(word):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


def _plain(rows, min_docs=divergence.MIN_DOCS, top=divergence.TOP_TERMS):
    docs = [(lang or "", source or "", [_lower(w) for w in TERM.findall(text or "")])
            for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, words in mine for t in set(words))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, words in mine:
            counts[s].update(w for w in words if df[w] >= min_docs)

        def shares(c, kept=kept):
            total = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        whole = shares(sum(counts.values(), Counter()))

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        for s in counts:
            pairs = sorted((-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o)
                           for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)]
            words = sorted((-gap(p[s][t], whole[t]), t.encode(), t) for t in kept
                           if counts[s][t] and p[s][t] > whole[t])[:top]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(words)]
    return sorted(out)


def _rows():
    rng = random.Random(13)
    words = [f"w{chr(97 + i)}" for i in range(20)] + ["Été", "ÉTÉ", "naïve", "ß", "语言", "😀x", "IT's"]
    rows = []
    for i in range(400):
        source = "hot" if rng.random() < 0.4 else f"s{i % 5}"
        lang = rng.choice(["en", "en", "en", "de"])
        few = words if source == "hot" else words[i % 5:]
        text = " ".join(rng.choice(few) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, lang, source, "t", 1, 0.5, "c", "d"))
    rows += [(500 + i, "Copied text over and over", "en", "hot" if i % 3 else "s1", *rows[0][4:])
             for i in range(150)]
    rows += [(None, None, None, None, None, None, None, None, None),
             (7, "", "en", "empty only", None, None, None, None, None),
             (7, "", "en", "empty only", None, None, None, None, None),
             (8, "ein Wort", "nl", "one", None, None, None, None, None),
             (9, "zwei Worte", "nl", "two", None, None, None, None, None),
             (10, "long " * 100_000 + "wa", "en", "s2", None, None, None, None, None)]
    return rows


def _got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("tally_bytes", [divergence.TALLY_BYTES, 200])
def test_equals_plain_evaluation(spark, monkeypatch, tally_bytes):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(divergence, "TALLY_BYTES", tally_bytes)
    assert _got(divergence.divergence(docs)) == _plain(rows)


def test_other_columns_and_no_rows(spark):
    rows = _rows()[:200]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed(
        {"text": "body", "lang": "language", "source": "site"})
    got = divergence.divergence(docs, "language", "site", "body", min_docs=3, top=4)
    assert _got(got) == _plain(rows, 3, 4)
    empty = divergence.divergence(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    assert set(empty.columns) == {"lang", "source", "part", "item", "value", "rank"}


def test_copies_are_tokenized_once(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    distinct = {(r[2] or "", r[1] or "") for r in _rows()}
    rows = divergence.collapsed(docs).collect()
    assert len(rows) == len(distinct)
    copied = next(r for r in rows if r.text.startswith(b"Copied"))
    assert [tuple(c) for c in copied.copies] == [("hot", 100), ("s1", 50)]


def test_terms():
    found = divergence.terms("A b\u00c9b_c1d \u4e16\u00a0x".encode())
    assert found == [b"a", "b\u00c9b".encode(), b"c", b"d", "\u4e16\u00a0x".encode()]


def test_shares_beyond_long_products(spark):
    table = spark.sql("select 90000000000L as n, 270000000001L as total, 7L as kept")
    assert table.select(divergence._share("n", "total")).first()[0] == (
        1 + 10 ** 9 * 90_000_000_002 // 270_000_000_015)
