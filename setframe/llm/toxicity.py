"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts, digits and signs that stand for
letters, invisible characters. Entries match at the start of a word. Phrases found harmless in clean
documents cancel the matches inside them. The weighted matches of a document, as they are and against
its length, give a probability.

Entries, weights, phrases and the final curve are learned from a bounded sample of labelled rows
(``per_class`` of either class); the counting runs in Spark, and only entries that pass the tests of
support and lift reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.llm.columns import fold, labelled_sample, ship, texts

# Characters that stand for a Latin letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
              "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
              "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d",
              "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = str.maketrans({**LOOKALIKES, **dict.fromkeys(INVISIBLE),
                        **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_WORD = re.compile(r"[^\W\d_]+")

SHORTEST, LONGEST = 3, 12
PER_CLASS = 3000
#: An entry must be in this share of the toxic sample, and in this many documents, ...
SUPPORT, LEAST_SUPPORT = 0.01, 3
#: ... and so many times as frequent there as in the clean sample.
LIFT = 20.0
#: Twice the gain in log likelihood that keeps chance entries out among very many candidates.
GAIN = 20.0
#: A longer entry replaces a shorter one that it nearly always continues.
SAME = 0.97


def folded(text: str) -> str:
    return text.lower().translate(_TABLE)


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, harmless phrases, and the curve from matches to probability."""

    weights: tuple[tuple[str, float], ...] = ()
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def matches(self, text: str) -> list[tuple[int, str]]:
        """(start, entry) of every entry at the start of a word of a folded text, outside phrases."""
        if not self.weights:
            return []
        found, covered = [], []
        for last, (entry, harmless) in _automaton(self.weights, self.exceptions).iter(text):
            start = last + 1 - len(entry)
            if start and text[start - 1].isalpha():
                continue
            if harmless:
                covered.append((start, last))
            else:
                found.append((start, entry))
        return _outside(found, covered)

    def features(self, text: str) -> tuple[float, float]:
        weight = _weights(self.weights)
        text = folded(text)
        total = sum(weight[e] for _, e in self.matches(text))
        return log1p(total), log1p(1000.0 * total / (text.count(" ") + 1))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, z))))


def _outside(found: list[tuple[int, str]], covered: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """Matches that start in none of the covered stretches; both lists are walked once."""
    covered = sorted(covered)
    out, at, reach = [], 0, -1
    for start, entry in sorted(found):
        while at < len(covered) and covered[at][0] <= start:
            reach = max(reach, covered[at][1])
            at += 1
        if start > reach:
            out.append((start, entry))
    return out


@lru_cache(maxsize=4)
def _weights(weights: tuple) -> dict[str, float]:
    return dict(weights)


@lru_cache(maxsize=4)
def _automaton(weights: tuple, exceptions: tuple) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for entry, _ in weights:
        automaton.add_word(entry, (entry, False))
    for phrase in exceptions:
        automaton.add_word(phrase, (phrase, True))
    if len(automaton):
        automaton.make_automaton()
    return automaton


# ---- learning -----------------------------------------------------------------------------

@dataclass(frozen=True)
class Fit:
    """The bounds of the fit."""

    per_class: int = PER_CLASS
    support: float = SUPPORT
    lift: float = LIFT
    exceptions: tuple[str, ...] = field(default=())


def _prefixes(text: str) -> set[str]:
    return {w[:n] for w in set(_WORD.findall(folded(text)))
            for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for value, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            (toxic if y else clean).update(_prefixes(value))
        entries = list(toxic | clean)
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entries, pa.string()),
                                          "toxic": pa.array([toxic[e] for e in entries], pa.int64()),
                                          "clean": pa.array([clean[e] for e in entries], pa.int64())})


def _choose(counts: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The shortest entries that stand out, each lengthened while that loses next to nothing."""
    chosen: dict[str, float] = {}
    for entry in sorted(counts, key=lambda e: (len(e), e)):
        if any(entry.startswith(c) or c.startswith(entry) for c in chosen):
            continue
        while True:
            longer = [e for e in counts if len(e) == len(entry) + 1 and e.startswith(entry)
                      and counts[e][0] >= SAME * counts[entry][0]]
            if not longer:
                break
            entry = max(longer, key=lambda e: (counts[e][0], e))
        toxic, clean = counts[entry]
        chosen[entry] = log((toxic + 0.5) / (n_toxic + 1.0) * (n_clean + 1.0) / (clean + 0.5))
    return chosen


def _count_phrases(lexicon: Lexicon):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, a, b, phrases = [], [], [], []
            for value, y in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                first, second = lexicon.features(value)
                text = folded(value)
                around = {phrase for start, entry in lexicon.matches(text)
                          if (phrase := _phrase(text, start, entry))}
                ys.append(y)
                a.append(first)
                b.append(second)
                phrases.append(sorted(around))
            yield pa.RecordBatch.from_pydict({
                "y": pa.array(ys, pa.int32()), "a": pa.array(a, pa.float64()),
                "b": pa.array(b, pa.float64()), "phrases": pa.array(phrases, pa.list_(pa.string()))})
    return count


def _phrase(text: str, start: int, entry: str) -> str | None:
    """The word before a match, with the match."""
    before = re.search(r"([^\W\d_]+ )$", text[max(0, start - 40):start])
    return before[1] + entry if before else None


def _curve(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; toxic rows weigh ``prior`` together."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    beta, ridge = np.zeros(3), np.diag([1e-4, 1e-3, 1e-3])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge @ beta
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return tuple(float(v) for v in beta)


def learn(sample: DataFrame, fit: Fit | None = None, prior: float | None = None) -> Lexicon:
    """A lexicon from rows ``(t, y)``; ``prior`` is the share of toxic rows where the sample does not
    show it. Without rows of both classes it matches nothing and every
    score is the share of toxic rows (0.5 without rows)."""
    fit = fit or Fit()
    ship(sample.sparkSession)
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1.0)
        return Lexicon(curve=(log(share / (1.0 - share)), 0.0, 0.0))
    rate = (F.col("toxic") + 0.5) / (n_toxic + 1.0) * (n_clean + 1.0) / (F.col("clean") + 0.5)
    least = max(LEAST_SUPPORT, fit.support * n_toxic)
    share = F.col("toxic") / (F.col("toxic") + F.col("clean")) * ((n_toxic + n_clean) / n_toxic)
    gain = 2 * F.col("toxic") * F.log(share)
    found = (sample.mapInArrow(_count_entries, "entry string, toxic bigint, clean bigint")
             .groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") >= least) & (gain >= GAIN) & (rate >= min(fit.lift, (n_clean + 1.0) / 2))))
    counts = {r.entry: (r.toxic, r.clean) for r in found.collect()}
    weights = tuple(sorted(_choose(counts, n_toxic, n_clean).items()))
    lexicon = Lexicon(weights, fit.exceptions)
    seen = sample.mapInArrow(_count_phrases(lexicon),
                             "y int, a double, b double, phrases array<string>")
    harmless = (seen.select("y", F.explode("phrases").alias("phrase")).groupBy("phrase")
                .agg(F.sum(F.col("y")).alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
                .where(f"clean >= {LEAST_SUPPORT} and clean * {n_toxic} > toxic * {n_clean}"))
    learned = [r.phrase for r in harmless.collect()]
    if learned:
        lexicon = Lexicon(weights, tuple(sorted({*fit.exceptions, *learned})))
        seen = sample.mapInArrow(_count_phrases(lexicon),
                                 "y int, a double, b double, phrases array<string>")
    points = seen.select("y", "a", "b").toPandas()
    return Lexicon(weights, lexicon.exceptions,
                   _curve(points[["a", "b"]].to_numpy(), points["y"].to_numpy(),
                          prior or n_toxic / (n_toxic + n_clean)))


# ---- scoring ------------------------------------------------------------------------------

def toxicity(text: str | Column, lexicon: Lexicon) -> Column:
    """The probability that a text is toxic; NULL reads as empty."""
    @F.arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(t) for t in texts(values)], pa.float64())
    return score(text)


def matched_entries(text: str | Column, lexicon: Lexicon) -> Column:
    """The matches in a folded text as ``array<struct<start, entry>>``."""
    @F.arrow_udf("array<struct<start: int, entry: string>>")
    def match(values: pa.Array) -> pa.Array:
        rows = [[{"start": s, "entry": e} for s, e in lexicon.matches(folded(t))]
                for t in texts(values)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("entry", pa.string())]))
        return pa.array(rows, kind)
    return match(text)


def learned_from(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1,
                 fit: Fit | None = None, key: str = "doc_id", text: str = "text",
                 label: str = "toxic") -> Lexicon:
    """A lexicon from the labelled rows outside the held-out fold."""
    fit = fit or Fit()
    sample = labelled_sample(docs, labels, key, text, label, fold(key, folds) != held_out,
                             fit.per_class)
    train = labels.where(fold(key, folds) != held_out)
    prior = train.agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    return learn(sample, fit, prior)


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, folds: int = 3,
           held_out: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every row; other columns are not read.

    Empty and NULL texts get the score of a text without matches. There is no shuffle.
    """
    rows = docs.select(F.col(key), toxicity(text, lexicon).alias("score"))
    return rows.select(key, (fold(key, folds) == held_out).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
