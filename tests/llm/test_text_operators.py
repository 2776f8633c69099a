"""BPE, exact duplicates, near-duplicates, toxicity, quality, personal data: small cases."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from setframe.llm import bpe, exact_dedup, minhash_forest, pii, quality, toxicity

RANKS = bpe.parse_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                            special_tokens={})
EDGES = [(1, ""), (2, None), (3, " \n "), (None, "The same Text"), (4, "the same text"),
         (4, "the same text"), (5, "word " * 6000), (6, "naïve 漢字 😀 x²"), (7, "the same text")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, True, "z") for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, kept boolean, k string")


# ---- BPE ----------------------------------------------------------------------------------

def test_tree_encodes_like_the_library():
    codec, rng = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    kinds = ["ab", "aa a", "the ouionñé ", "=-_*", "01 2\t\n ", "\x1c\x85\xa0 ab", "漢字 ab²½", "'s're S"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.choice([0, 1, 9, 60])))
        text *= rng.choice([1, 1, 40])
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == LIBRARY.encode_ordinary(text)
        assert codec.decode_packed(packed) == text.encode()


def test_blocks_are_decoded_up_a_tree(monkeypatch):
    monkeypatch.setattr(bpe, "_BLOCK_IDS", 4)
    codec = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)
    for text in ("", "a", "some words, 123 and 世界 😀 over and over " * 20):
        packed = codec.encode(text)
        assert codec.decode_packed(packed) == text.encode()


def test_small_tables_change_nothing(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcxyz.,é") for _ in range(rng.randint(1, 9))) for _ in range(60))
             for _ in range(40)]
    codec = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)
    want = [codec.encode(t) for t in texts]
    for name in ("REMEMBERED_WORDS", "REMEMBERED_SHORT", "REMEMBERED_PAIRS"):
        monkeypatch.setattr(bpe, name, 8)
    small = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)
    assert [small.encode(t) for t in texts] == want
    assert all(len(t) <= 8 for t in (small._first, small._later, small._short, small._pairs))


def test_patterns_with_spaces_elsewhere():
    for pattern in (r"\S+ ?|\s", r"[a-z]+ [a-z]+|\s|\S", r"(?:\S+ )*\S+|\s", public_tokenizers.PATTERN):
        codec = bpe.BytePairCodec(RANKS, pattern)
        for text in ("some words here", "a b", "x, y 12 z's ", " lead"):
            assert codec.encode(text) == codec.pack(text), (pattern, text)


def test_long_periodic_piece():
    codec = bpe.BytePairCodec(RANKS, public_tokenizers.PATTERN)
    for text in ("a" * 50_000, "abcab" * 9000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_round_trip(spark, docs):
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN)
    rows = bpe.round_trip(docs, vocabulary).collect()
    want = []
    for key, text in EDGES:
        ids = np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()
        want.append((key, len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.round_trip(docs.limit(0), vocabulary).collect() == []
    assert base64.b64decode(b"YQ==") == b"a"


# ---- exact duplicates ---------------------------------------------------------------------

def test_fingerprints_compose():
    data = random.Random(1).randbytes(3 * exact_dedup.CHUNK_BYTES + 77)
    whole = exact_dedup.fingerprint(data)
    for cuts in ([0], [1, 5000], [4096, 8192, 9000]):
        edges = [0, *cuts, len(data)]
        parts = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        assert exact_dedup.fingerprint_of_parts(parts) == whole
    value = 0
    for byte in data:
        value = (value * exact_dedup.BASES[0] + byte) % exact_dedup.MODULI[0]
    assert whole == (len(data), (value, whole.residues[1]))


def test_exact_duplicates(docs):
    rows = [tuple(r)[:4] for r in exact_dedup.exact_duplicates(docs).collect()]
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (None, 7, 4, False),
            (4, 7, 4, False), (4, 7, 4, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 4, True)]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    left = exact_dedup.without_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 5, 6, 7]
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_texts_with_equal_fingerprints_are_told_apart(spark, monkeypatch):
    weak = lambda data: exact_dedup.Fingerprint(len(data), (0, 0))
    monkeypatch.setattr(exact_dedup, "fingerprint", weak)
    texts = ["aaaa", "bbbb", "AAAA", "cccc", "bbbb", "dddd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "_prints", _weak_prints)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {0: (2, 2), 2: (2, 2), 1: (4, 2), 4: (4, 2), 3: (3, 1), 5: (5, 1)}


def _weak_prints(text):
    from pyspark.sql import functions as F
    zero = F.lit(0).cast("bigint")
    return F.struct(F.octet_length(text).cast("bigint").alias("length"), zero.alias("f1"),
                    zero.alias("f2"), F.sha2(F.lower(text), 256).alias("sha"))


@pytest.mark.parametrize("chars", [1, 3, 7])
def test_long_texts_are_compared_chunk_by_chunk(spark, monkeypatch, chars):
    """All texts share a fingerprint; they differ in the first, a middle or the last chunk, or nowhere."""
    monkeypatch.setattr(exact_dedup, "_prints", _weak_prints)
    monkeypatch.setattr(exact_dedup, "CHUNK_CHARS", chars)
    monkeypatch.setattr(exact_dedup, "MEMBERS_PER_COPY", 2)
    texts = ["abcdefghij", "ABCDEFGHIJ", "Xbcdefghij", "abcdXfghij", "abcdefghiX", "abcdEfghij", "abcdexghij"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(docs).collect()}
    want = {}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if u.lower() == t.lower()]
        want[i] = (max(same), len(same))
    assert got == want


# ---- near-duplicates ----------------------------------------------------------------------

def _set(text):
    words = (text or "").lower().encode().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def _components(texts, percent):
    sets, root = [_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.choice([1, 3, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, n long")
    sizes, roots = _components(texts, 80)
    got = {r.doc_id: r for r in minhash_forest.near_duplicates(docs).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert all(got[i].kept == (roots[i] == i) for i in got)
    left = minhash_forest.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(roots))


def test_near_duplicates_of_odd_rows(docs):
    rows = {(r.doc_id, r.n_shingles, r.component_id, r.kept)
            for r in minhash_forest.near_duplicates(docs).collect()}
    assert rows == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, 4, False),
                    (4, 1, 4, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 4, False)}
    assert minhash_forest.near_duplicates(docs.limit(0)).collect() == []


# ---- toxicity -----------------------------------------------------------------------------

def test_folding_and_phrases():
    lexicon = toxicity.Lexicon((("stupid", 3.0),), ("not stupid",), (-2.0, 3.0, 0.5))
    for text in ("STUPID", "stup1d", "ѕtupіd", "s​tupid", "so stupidly"):
        assert lexicon.score(text) > 0.7, text
    for text in ("", "superstupid", "it is not stupid", "stu pid"):
        assert lexicon.score(text) < 0.3, text


def test_lexicon_is_learned(spark, docs):
    rng = random.Random(2)
    words = ["haus", "baum", "wald", "see", "berg", "tal", "weg"]
    rows, marks = [], []
    for i in range(400):
        text = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            text[rng.randrange(30)] = rng.choice(["grmblx", "zorkify"])
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 4 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (9, None)], "doc_id long, toxic int")
    lexicon = toxicity.learned_from(table, labels)
    assert {e[:3] for e, _ in lexicon.weights} == {"grm", "zor"}
    out = toxicity.scored(table, lexicon).join(labels, "doc_id")
    assert out.where("held_out and predicted <> toxic").count() == 0
    odd = toxicity.scored(docs, lexicon).collect()
    assert len(odd) == len(EDGES) and all(0 <= r.score <= 1 for r in odd)
    none = toxicity.learned_from(table, labels.limit(0))
    assert none.weights == () and none.score("x") == 0.5


# ---- quality ------------------------------------------------------------------------------

def _noisy(rng, junk):
    words = ["haus", "baum", "wald", "see", "berg", "tal", "weg"]
    return " ".join(rng.choice(words) + ("$$$" if junk else "") for _ in range(rng.randint(5, 80)))


def test_network_learns_and_covers_whole_texts():
    rng = random.Random(6)
    y = np.array([i % 2 for i in range(160)], float)
    texts = [_noisy(rng, not v).encode() for v in y]
    net = quality.train(texts, y, epochs=6)
    held = [_noisy(rng, i % 2).encode() for i in range(60)]
    assert ((net.score(held) >= 0.5) == np.array([i % 2 == 0 for i in range(60)])).mean() >= 0.95
    start = b"haus " * 2000
    assert net.score([start + b"$$$ " * 2000])[0] < net.score([start + start])[0]
    alone = np.array([net.score([t])[0] for t in held])
    assert np.allclose(alone, net.score(held), atol=1e-5)
    assert quality.train([], np.empty(0)).score([b""])[0] == pytest.approx(0.5)


def test_quality_of_odd_rows(docs):
    net = quality.train([b"a b", b"$$"] * 8, np.array([1.0, 0.0] * 8), epochs=2)
    rows = quality.scored(docs, net).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs.limit(0), net).collect() == []


# ---- personal data ------------------------------------------------------------------------

def _patterns(text):
    out = [(m.start(), 0, m.end()) for m in
           re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in
            re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19),
                                     (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == 3 or pii.luhn(digits)):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b.", "@", "@@", "1", "23", ".", "-", " ", "+", "(", ")", "_", "é", "%", "255.1.",
             "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "+1 (2)"]
    for _ in range(8000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == _patterns(text), text
        base, every = pii.all_spans(text, pii.PRIOR)
        assert set(base) <= set(every)


def _best_by_enumeration(edges, found, weights, at=0):
    if at >= len(edges) - 1:
        return 0.0
    best = _best_by_enumeration(edges, found, weights, at + 1)
    for i, j, kind, features in found:
        if i == at:
            best = max(best, float(np.dot(features, weights[kind]))
                       + _best_by_enumeration(edges, found, weights, j))
    return best


def test_decoding_is_the_best_segmentation():
    for text in ("call 244-555-4688 or +1 (22) 33-4455", "a(at)b.de 1.2.3.4", "4111-1111-1111-1111 12"):
        for start, stop in pii.islands(text):
            edges, found = pii.candidates(text, start, stop)
            spans = pii.decode(edges, found, pii.PRIOR)
            score = sum(float(np.dot(f, pii.PRIOR[k])) for i, j, k, f in found
                        if (edges[i], k, edges[j]) in spans)
            assert score == pytest.approx(_best_by_enumeration(edges, found, pii.PRIOR))


def test_field_adds_what_patterns_miss(docs):
    weights = pii.fit(["write to a.b@c.de or +1 (244) 555-4688 or 10.0.0.1", "x", ""] * 5)
    for text, kind in (("phone: (244) 555-4688", 3), ("mail bob(at)example(dot)com", 0),
                       ("card 4111.1111.1111.1111", 2)):
        assert [s[1] for s in pii.all_spans(text, weights)[1]] == [kind]
    assert pii.all_spans("order 123456789 of 2024", weights)[1] == []
    rows = pii.personal_data(docs, weights).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == len(EDGES) and all(r.base_sha256 == empty and r.spans == "" for r in rows)
    assert pii.personal_data(docs.limit(0), pii.learned_from(docs.limit(0))).collect() == []


def test_field_finds_spaced_and_spelt_out_addresses(spark):
    sample = ["write to a.b@c.de or +1 (244) 555-4688 or 10.0.0.1", "x", "you (at) home (dot) org"] * 5
    weights = pii.fit(sample)
    addresses = ["bob (at) example (dot) com", "bob @ example.com", "bob.s [AT] mail {dot} example.com",
                 "bob @ example . com", "bob (dot) s (at) example (dot) com", "bob @example.com",
                 "bob(at)example (dot) com", "bob7 (at) 3com (dot) com", "bob@ example.com"]
    texts = [f"{before}{a}{after}" for a in addresses
             for before in ("", "ask our ", "in 2024 ", "Hi.\n", "mr. ") for after in ("", " today", ". Yes", " 17")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.spans for r in pii.personal_data(docs, weights).collect()}
    for i, text in enumerate(texts):
        address = next(a for a in sorted(addresses, key=len, reverse=True) if a in text)
        at = text.index(address)
        assert rows[i] == f"email:{at}:{at + len(address)}", text


def test_context_counts_before_every_candidate():
    features = {}
    for text in ("2024 phone 5554688", "2024 phone " + "." * 40 + " 5554688", "2024 other 5554688"):
        (start, stop), = [i for i in pii.islands(text) if text[i[0]:i[1]].endswith("5554688")]
        edges, found = pii.candidates(text, start, stop)
        features[text] = [f[2] for i, j, kind, f in found
                          if kind == 3 and text[edges[i]:edges[j]] == "5554688"]
    assert list(features.values()) == [[1.0], [1.0], [0.0]]
    text = "12-34 @phone 5554688"
    (start, stop), = pii.islands(text)
    edges, found = pii.candidates(text, start, stop)
    assert [f[2] for i, j, kind, f in found if kind == 3 and text[edges[i]:edges[j]] == "5554688"] == [1.0]


def test_islands_are_ordered_runs_of_whole_tokens():
    rng = random.Random(8)
    parts = ["bob", "(at)", "@", "(dot)", ".", "x.", "7", "+1", " ", " ", " ", "  ", "\n", "[dot]"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))
        spans = list(pii.islands(text))
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)), text
        for start, stop in spans:
            assert start == 0 or text[start - 1].isspace()
            assert stop == len(text) or text[stop].isspace()
        covered = {k for start, stop in spans for k in range(start, stop)}
        assert covered >= {k for k, c in enumerate(text) if c in "@17"}, text


def _near(rng, words, text, target):
    """A text whose shingles have a similarity to those of ``text`` just above or below ``target``
    percent, made by changing words."""
    copy = text.split()
    while True:
        before = " ".join(copy)
        copy[rng.randrange(len(copy))] = rng.choice(words)
        a, b = _set(text), _set(" ".join(copy))
        if 100 * len(a & b) < target * len(a | b):
            return before


def test_recall_just_above_the_threshold(spark):
    """Hundreds of pairs just above the threshold, and regions crowded by a shared passage."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(5000)]
    for percent in (85, 80):
        passage = [rng.choice(words) for _ in range(60)]
        texts = []
        for i in range(400):
            base = passage * (i % 2) + [rng.choice(words) for _ in range(rng.randint(60, 200) if i % 2 == 0 else 45)]
            texts.append(" ".join(base))
            texts.append(_near(rng, words, texts[-1], percent))
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, percent).collect()}
        sets = [_set(t) for t in texts]
        linked = [i for i in range(0, 800, 2) if 100 * len(sets[i] & sets[i + 1]) >= percent * len(
            sets[i] | sets[i + 1])]
        assert len(linked) == 400
        assert all(got[i] == got[i + 1] for i in linked)
        assert all(got[i] == i for i in linked)  # and nothing else is joined


def test_crowded_regions_equal_brute_force(spark, monkeypatch):
    """Regions far larger than the window, cut over several ranges and compared in several blocks."""
    monkeypatch.setattr(minhash_forest, "WINDOW", 3)
    monkeypatch.setattr(minhash_forest, "WHOLE", 20)
    monkeypatch.setattr(minhash_forest, "BLOCK", 16)
    rng = random.Random(33)
    words = [f"w{i}" for i in range(400)]
    texts = []
    passage = [rng.choice(words) for _ in range(70)]
    for size in (90, 40, 25, 3, 2):
        base = passage + [rng.choice(words) for _ in range(25)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(25)]) for _ in range(120)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (85, 80):
        _, roots = _components(texts, percent)
        got = {r.doc_id: r.component_id for r in minhash_forest.near_duplicates(docs, percent).collect()}
        assert [got[i] for i in range(len(texts))] == roots
