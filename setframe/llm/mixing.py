"""Mixing sources to target weights by iterative proportional fitting, with column expressions only.

Tokens are summed by cell (source, language, topic). The cell table is raked: in turn for each dimension
its weights are scaled so that the dimension's marginals are the targets. A target is a table of shares,
or an exponent: each value's share is then proportional to its tokens to that power, which damps a
source that holds a large part of everything. Documents are sampled with the probability at which
the expected tokens of each cell follow the raked weights and those of all cells the budget; a cell that
cannot give its weight is taken whole and the rest share the remainder.

Only cell sums move between machines: one partial sum per task and cell, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.session import broadcast_if_small, materialise

#: Up to so many cells the raking is planned as one task; beyond, its sums are shuffled.
CELLS_IN_ONE_TASK = 50_000
NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")

# What marks a topic, in order of precedence.
TOPIC_MARKS = (("legal", "Licensed under"), ("table", " | "), ("notice", "!!"), ("markup", "***"))
OTHER_TOPIC = "prose"


@dataclass(frozen=True)
class Mixture:
    """``targets``: for each dimension shares by value, or an exponent. Values without a share are not
    sampled; shares are normalised over the values that occur. ``budget`` is the part of all tokens.
    ``topic`` is a column of the documents that names each one's topic; without one, marks in the text
    tell a few kinds apart (:func:`topic`).

    Targets that no weights meet together (such as sources of one language each, with shares that do not
    add up to the languages') are followed in turn, the last dimension's exactly; :func:`marginals` says
    what each value was to have and has."""

    targets: dict[str, dict[str, float] | float] = field(
        default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.7})
    budget: float = 0.6
    rounds: int = 12
    seed: int = 42
    topic: Column | None = None


def topic(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    found = F
    for name, mark in TOPIC_MARKS:
        found = found.when(F.contains(text, F.lit(mark)), F.lit(name))
    return found.otherwise(F.lit(OTHER_TOPIC))


def token_count(text: str | Column = "text") -> Column:
    """Words of a text; NULL has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _cell(text: str, mixture: Mixture) -> list[Column]:
    """Source, language and topic of a row; NULL is a value of its own."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(f"__sf_{c}")
               for c in ("source", "lang")]
    own = topic(text) if mixture.topic is None else F.coalesce(mixture.topic.cast("string"), F.lit(NONE))
    return [*columns, own.alias("__sf_topic")]


_CELL = [f"__sf_{d}" for d in DIMENSIONS]


def _targets(cells: DataFrame, mixture: Mixture) -> DataFrame:
    """Adds a column ``t_<dimension>``: the target share of the cell's value."""
    whole = Window.partitionBy()
    for d in DIMENSIONS:
        value, target = f"__sf_{d}", mixture.targets[d]
        if isinstance(target, dict):
            raw = F.lit(0.0)
            for name, share in target.items():
                raw = F.when(F.col(value) == name, F.lit(float(share))).otherwise(raw)
        else:
            raw = F.pow(F.sum("tokens").over(Window.partitionBy(value)).cast("double"), F.lit(target))
        cells = cells.withColumn("raw", raw)
        first = F.row_number().over(Window.partitionBy(value).orderBy(*_CELL)) == 1
        cells = cells.withColumn("once", F.when(first, F.col("raw")))
        cells = cells.withColumn(f"t_{d}", F.col("raw") / F.sum("once").over(whole))
    return cells.drop("raw", "once")


def raked_cells(docs: DataFrame, mixture: Mixture, text: str = "text") -> DataFrame:
    """One row for every cell: its values, ``tokens``, raked ``weight`` and probability ``p``."""
    return _raked(docs.select(*_cell(text, mixture), token_count(text).alias("n")), mixture)


def _raked(rows: DataFrame, mixture: Mixture) -> DataFrame:
    cells = materialise(rows.groupBy(*_CELL).agg(F.sum("n").alias("tokens")), "cells")
    if cells.count() <= CELLS_IN_ONE_TASK:
        cells = cells.coalesce(1)
    whole = Window.partitionBy()
    total = F.sum("tokens").over(whole).cast("double")
    cells = _targets(cells, mixture).withColumn("total", total)
    cells = cells.withColumn("weight", F.col("tokens") / F.col("total"))
    for _ in range(mixture.rounds):
        for d in DIMENSIONS:
            have = F.sum("weight").over(Window.partitionBy(f"__sf_{d}"))
            cells = cells.withColumn("weight", F.when(
                have > 0, F.col("weight") * F.col(f"t_{d}") / have).otherwise(0.0))
    # The level at which the budget is spent: cells below it are taken whole.
    ratio = F.col("tokens") / F.col("weight")
    order = Window.orderBy(F.col("ratio").asc_nulls_last(), *_CELL)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ratio", F.when(F.col("weight") > 0, ratio))
    spent = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.when(F.col("weight") > 0, (F.col("total") * mixture.budget - spent)
                   / F.greatest(left, F.col("weight")))
    cells = cells.withColumn("level", level)
    cells = cells.withColumn("level", F.max("level").over(whole))
    share = F.when(F.col("tokens") == 0, 1.0).when(F.col("weight") <= 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.col("level") * F.col("weight") / F.col("tokens")))
    out = cells.select(*_CELL, "tokens", "weight", share.alias("p"), *[f"t_{d}" for d in DIMENSIONS])
    return materialise(out, "raked")


def marginals(docs: DataFrame, mixture: Mixture | None = None, text: str = "text") -> DataFrame:
    """``(dimension, value, target, reached, error)`` of every value: the share of the weight that it was
    to have and the share that raking gave it. Where ``error`` is not close to 0 the targets do not go
    together, or ``rounds`` were too few."""
    mixture = mixture or Mixture()
    cells = raked_cells(docs, mixture, text)
    parts = [cells.groupBy(F.col(f"__sf_{d}").alias("value")).agg(
        F.max(f"t_{d}").alias("target"), F.sum("weight").alias("reached")).select(
        F.lit(d).alias("dimension"), "value", "target", "reached") for d in DIMENSIONS]
    table = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return table.withColumn("error", F.abs(F.col("reached") - F.col("target")))


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of a digest."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def probabilities(docs: DataFrame, mixture: Mixture | None = None, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """``key, source, lang, topic, n_tokens, p, sampled`` of every row.

    Repeated rows are sampled together; a NULL key is an empty one, a NULL source or language the
    value ``(none)``, and NULL texts have no tokens. A cell without tokens is kept: it costs nothing.
    """
    mixture = mixture or Mixture()
    narrow = materialise(docs.select(
        F.col(key).alias("k"), *_cell(text, mixture), token_count(text).alias("n"),
        F.col("source"), F.col("lang")), "narrow")
    cells = _raked(narrow, mixture)
    rows = narrow.join(broadcast_if_small(cells.select(*_CELL, "p")), _CELL)
    return rows.select(F.col("k").alias(key), "source", "lang", F.col("__sf_topic").alias("topic"),
                       F.col("n").alias("n_tokens"), "p",
                       (uniform("k", mixture.seed) < F.col("p")).alias("sampled"))


def sampled(docs: DataFrame, mixture: Mixture | None = None, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """The sampled rows with all columns of ``docs``."""
    mixture = mixture or Mixture()
    cells = raked_cells(docs, mixture, text).select(*_CELL, F.col("p").alias("__sf_p"))
    placed = docs.withColumns(dict(zip(_CELL, _cell(text, mixture), strict=True)))
    taken = placed.join(broadcast_if_small(cells), _CELL)
    return taken.where(uniform(key, mixture.seed) < F.col("__sf_p")).select(
        *(F.col(f"`{c}`") for c in docs.columns))
