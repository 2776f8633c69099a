"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

The patterns give the base spans, which always stay. The field looks at islands, the runs of tokens
that hold a digit, an ``@`` or a spelt-out one, with the words that such a sign or a spelt-out dot joins
to them (``bob (at) example (dot) com``). An island is cut into atoms (letters, digits, single signs); every segment of at most ``MAX_ATOMS`` atoms is a candidate for each kind it could be, scored
by features of the whole span (check sum, octets, groups, what stands around it). Dynamic programming
over the atoms chooses boundaries and kinds together. Its spans that touch no base span are added.

Weights are fitted to the base spans of a bounded sample of rows by the likelihood of whole
segmentations, with a Gaussian prior around ``PRIOR``, so that the field keeps what the patterns cannot
show it (numbers without a plus, spelt-out addresses).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.llm.columns import struct_array, texts
from setframe.session import ship_package

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS, MAX_CHARS = 16, 80
#: Texts that the field is fitted on, at most, and the characters that such a text may have.
SAMPLE_ROWS, SAMPLE_CHARS = 600, 1 << 14

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails or matches from its first digit, so later ones are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        value = int(d) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap, by start and then kind."""
    found: list[Span] = []
    at, past = text.find("@"), 0
    while at >= 0:
        # A match for this sign starts at the first character of the run before it.
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            past = match.end()
        at = text.find("@", max(at + 1, past))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- candidates ---------------------------------------------------------------------------

_MARK = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.IGNORECASE)
_ATOM = re.compile(r"[(\[{](?:at|dot)[)\]}]|[A-Za-z]+|[0-9]+|.", re.IGNORECASE | re.DOTALL)
_AT = re.compile(r"@|[(\[{]at[)\]}]", re.IGNORECASE)
_SPACED_AT = re.compile(r" ?(?:@|[(\[{]at[)\]}]) ?", re.IGNORECASE)
_SPACED_DOT = re.compile(r" ?[(\[{]dot[)\]}] ?| \. ", re.IGNORECASE)
_GOES_ON = re.compile(r"(?:-+|\.| ?[(\[{]dot[)\]}] ?| \. )[A-Za-z0-9]", re.IGNORECASE)
_JOINS_NEXT = re.compile(r"(?:@|[(\[{](?:at|dot)[)\]}]|(?:^|\s)\.)$", re.IGNORECASE)
_JOINS_LAST = re.compile(r"@|[(\[{](?:at|dot)[)\]}]|\.(?=\s|$)", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_GROUPS = re.compile(r"[0-9]+")
_CONTEXT = tuple(re.compile(p, re.IGNORECASE) for p in (
    r"\b(?:e-?mail|contact|write)$", r"\b(?:ip|host|server|address)$",
    r"\b(?:card|visa|credit|account)$", r"\b(?:tel|phone|call|fax|mobile)$"))
_LONGEST_CONTEXT = 7

# Prior means of the weights. Columns: constant, clean edges, word before, and the
# span's own features in the order of ``_features``.
PRIOR = np.array([[-6.0, 1.0, 2.0, 2.0, 2.0, 1.0, 2.0],
                  [-6.0, 2.0, 2.0, 3.0, 1.0, 1.0, 1.0],
                  [-7.0, 2.0, 2.0, 5.0, 1.0, 1.0, 0.5],
                  [-6.5, 2.0, 3.0, 3.0, 1.0, 2.0, 1.0]])


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of marked tokens with one blank between them."""
    start = stop = -1
    for mark in _MARK.finditer(text):
        if mark.start() < stop:
            continue
        left = mark.start()
        while left > max(stop, 0) and not text[left - 1].isspace():
            left -= 1
        right = mark.end()
        while right < len(text) and not text[right].isspace():
            right += 1
        if stop >= 0 and left - stop == 1 and text[stop] == " ":
            stop = right
            continue
        if stop >= 0:
            yield start, stop
        start, stop = left, right
    if stop >= 0:
        yield start, stop


def _reach_right(text: str, stop: int) -> int:
    """Past the following tokens, one blank apart, that an at-sign or dot joins to what ends here."""
    while stop + 1 < len(text) and text[stop] == " " and not text[stop + 1].isspace():
        if not (_JOINS_NEXT.search(text[max(0, stop - 5):stop]) or _JOINS_LAST.match(text, stop + 1)):
            break
        stop += 1
        while stop < len(text) and not text[stop].isspace():
            stop += 1
    return stop


def _reach_left(text: str, start: int, low: int) -> int:
    """The same to the left, down to ``low``."""
    while start - 1 > low and text[start - 1] == " " and not text[start - 2].isspace():
        if not (_JOINS_LAST.match(text, start)
                or _JOINS_NEXT.search(text[max(low, start - 6):start - 1])):
            break
        start -= 1
        while start > low and not text[start - 1].isspace():
            start -= 1
    return start


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of marked tokens, with the unmarked tokens that signs join to them."""
    start = stop = -1
    for left, right in _runs(text):
        if right <= stop:
            continue
        left, right = _reach_left(text, left, max(stop, 0)), _reach_right(text, right)
        if stop >= 0 and (left <= stop or (left - stop == 1 and text[stop] == " ")):
            stop = right
            continue
        if stop >= 0:
            yield start, stop
        start, stop = left, right
    if stop >= 0:
        yield start, stop


def _context(text: str, at: int) -> tuple[bool, ...]:
    """For each kind, whether the last word before a position announces it."""
    while at > 0 and not (text[at - 1].isalnum() or text[at - 1] == "_"):
        at -= 1
    before = text[max(0, at - _LONGEST_CONTEXT - 1):at]
    return tuple(bool(p.search(before)) for p in _CONTEXT)


def _features(kind: int, span: str, digits: int) -> tuple[float, ...] | None:
    """Features of the whole span, or None where it cannot be of the kind."""
    if kind == 0:
        if len(_AT.findall(span)) != 1:
            return None
        plain = _SPACED_DOT.sub(".", _SPACED_AT.sub("@", span))
        if not _ADDRESS.fullmatch(plain):
            return None
        local, domain = plain.split("@")
        return (1.0, float(domain.rsplit(".", 1)[1].isalpha()), float(local[0].isalnum()),
                float(local[-1].isalnum() and domain[-1].isalnum()))
    if not (span[-1].isdigit() and digits >= 4) or re.search(r"[^0-9 ().+/-]", span):
        return None
    groups = _GROUPS.findall(span)
    if kind == 1:
        if span.count(".") != 3 or len(groups) != 4 or len(span) != digits + 3:
            return None
        return (float(all(len(g) < 4 and int(g) < 256 for g in groups)),
                float(not any(len(g) > 1 and g[0] == "0" for g in groups)), 1.0,
                float(span[0].isdigit()))
    signs = set(re.sub(r"[0-9]", "", span))
    if kind == 2:
        if not 12 <= digits <= 19 or not span[0].isdigit() or len(signs) > 1:
            return None
        return (float(luhn("".join(groups))),
                float(len(groups) == 1 or all(len(g) == 4 for g in groups[:-1])),
                float(digits in (15, 16)), float(len(groups) < 6))
    if not 7 <= digits <= 15 or not (span[0].isdigit() or span[0] in "+("):
        return None
    return (float(span[0] == "+" or groups[0].startswith("00")), float("(" in span and ")" in span),
            float(2 <= len(groups) <= 5 and max(map(len, groups)) <= 7),
            float(10 <= digits <= 12))


def candidates(text: str, start: int, stop: int):
    """Atoms' edges of an island, and its candidates ``(from, to, kind, features)``."""
    edges = [start, *(m.end() for m in _ATOM.finditer(text, start, stop))]
    found = []
    counts = np.cumsum([0, *(sum(c.isdigit() for c in text[a:b])
                             for a, b in zip(edges, edges[1:], strict=False))]).tolist()
    signs = [0]
    for a, b in zip(edges, edges[1:], strict=False):
        signs.append(signs[-1] + bool(_AT.fullmatch(text, a, b)))
    for i in range(len(edges) - 1):
        words = None
        for j in range(i + 1, min(len(edges), i + MAX_ATOMS + 1)):
            a, b = edges[i], edges[j]
            digits = counts[j] - counts[i]
            if b - a > MAX_CHARS:
                break
            addressed = signs[j] > signs[i]
            if digits < 4 and not addressed:
                continue
            span = text[a:b]
            clean = not ((a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()))
            if addressed:
                clean = clean and not _GOES_ON.match(text, b)
            for kind in (0,) if addressed else (1, 2, 3):
                own = _features(kind, span, digits)
                if own is not None:
                    words = words or _context(text, a)
                    found.append((i, j, kind, (1.0, float(clean), float(words[kind]), *own)))
    return edges, found


# ---- the field ----------------------------------------------------------------------------

def decode(edges: list[int], found: list, weights: np.ndarray) -> list[Span]:
    """The best segmentation: at each atom, either it is outside or a candidate ends there."""
    best, back = [0.0] * len(edges), [None] * len(edges)
    ending: dict[int, list] = {}
    if found:
        table = np.array([f[3] for f in found])
        scores = (table * weights[[f[2] for f in found]]).sum(axis=1).tolist()
        for (i, j, kind, _), score in zip(found, scores, strict=True):
            ending.setdefault(j, []).append((score, i, kind))
    for j in range(1, len(edges)):
        best[j] = best[j - 1]
        for score, i, kind in ending.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, kind)
    spans, j = [], len(edges) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            spans.append((edges[i], kind, edges[j]))
            j = i
    return spans[::-1]


def _expected(edges: list[int], found: list, weights: np.ndarray) -> np.ndarray:
    """Probabilities of the candidates under all segmentations."""
    n = len(edges)
    table = np.array([f[3] for f in found])
    scores = (table * weights[[f[2] for f in found]]).sum(axis=1)
    forward, backward = np.zeros(n), np.zeros(n)
    ends, begins = {}, {}
    for at, (i, j, _, _) in enumerate(found):
        ends.setdefault(j, []).append(at)
        begins.setdefault(i, []).append(at)
    for j in range(1, n):
        ways = [forward[j - 1], *(forward[found[k][0]] + scores[k] for k in ends.get(j, ()))]
        forward[j] = np.logaddexp.reduce(ways)
    for i in range(n - 2, -1, -1):
        ways = [backward[i + 1], *(backward[found[k][1]] + scores[k] for k in begins.get(i, ()))]
        backward[i] = np.logaddexp.reduce(ways)
    return np.exp([forward[i] + s + backward[j] - forward[-1]
                   for (i, j, _, _), s in zip(found, scores, strict=True)])


def fit(sample: list[str], epochs: int = 15, rate: float = 0.5, strength: float = 0.02) -> np.ndarray:
    """Weights from the base spans of some texts; without islands, the prior's.

    Spelt-out and spaced addresses, of which the patterns say nothing, are left out.
    """
    cases = []
    for text in sample:
        truth = set(base_spans(text))
        for start, stop in islands(text):
            edges, found = candidates(text, start, stop)
            found = [f for f in found
                     if f[2] or _ADDRESS.fullmatch(text, edges[f[0]], edges[f[1]])]
            if found:
                target = np.array([(edges[i], kind, edges[j]) in truth for i, j, kind, _ in found],
                                  float)
                cases.append((edges, found, target))
    weights = PRIOR.copy()
    for _ in range(epochs if cases else 0):
        gradient = strength * (PRIOR - weights)
        for edges, found, target in cases:
            error = target - _expected(edges, found, weights)
            np.add.at(gradient, [f[2] for f in found],
                      np.array([f[3] for f in found]) * error[:, None] / len(cases))
        weights += rate * gradient
    return weights


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and base spans with those of the field that touch none of them."""
    base = base_spans(text)
    starts, stops = _union([(s[0], s[2]) for s in base])
    extra = []
    for start, stop in islands(text):
        edges, found = candidates(text, start, stop)
        for span in decode(edges, found, weights):
            # The last stretch that starts before the span's end is the only one that may touch it.
            at = bisect_left(starts, span[2]) - 1
            if at < 0 or stops[at] <= span[0]:
                extra.append(span)
    return base, sorted(base + extra)


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover together."""
    starts: list[int] = []
    stops: list[int] = []
    for start, stop in spans:
        if stops and start <= stops[-1]:
            stops[-1] = max(stops[-1], stop)
        else:
            starts.append(start)
            stops.append(stop)
    return starts, stops


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def learned_from(docs: DataFrame, rows: int = SAMPLE_ROWS, text: str = "text",
                 chars: int = SAMPLE_CHARS) -> np.ndarray:
    """Weights fitted on at most ``rows`` different texts with marks and at most ``chars`` characters,
    those of the smallest digests.

    Digests are chosen first, so only the sample's own texts reach the driver, each once.
    """
    ship_package(docs.sparkSession)
    marked = docs.select(F.col(text).alias("t")).where(
        (F.length("t") <= chars) & F.col("t").rlike("[0-9@]"))
    marked = marked.withColumn("x", F.xxhash64("t"))
    edge = marked.select("x").distinct().orderBy("x").limit(rows).agg(F.max("x")).first()[0]
    if edge is None:
        return fit([])
    sample = marked.where(F.col("x") <= edge).groupBy("x").agg(F.min("t").alias("t"))
    return fit([r.t for r in sample.orderBy("x").collect()])


def found_in(text: str | Column, weights: np.ndarray) -> Column:
    """Spans of a text column as a struct: counts of the base spans by kind, the digest of the base
    spans, and all spans as ``kind:start:end``; NULL reads as empty."""
    kinds = ", ".join(f"n_{k} bigint" for k in KINDS)

    @F.arrow_udf(f"{kinds}, base_sha256 string, spans string")
    def find(values: pa.Array) -> pa.Array:
        counts, digests, joined = [[] for _ in KINDS], [], []
        for value in texts(values):
            base, spans = all_spans(value, weights)
            for kind in range(len(KINDS)):
                counts[kind].append(sum(s[1] == kind for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(spans))
        columns = {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)}
        return struct_array(**columns, base_sha256=pa.array(digests, pa.string()),
                            spans=pa.array(joined, pa.string()))
    return find(text)


def personal_data(docs: DataFrame, weights: np.ndarray, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row for every input row, repeated and NULL keys included; other columns are not read.

    Positions count characters; NULL and empty texts have no spans. There is no shuffle.
    """
    return docs.select(F.col(key), found_in(text, weights).alias("found")).select(key, "found.*")
