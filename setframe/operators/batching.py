"""Class-proportional mini-batches."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.config import BATCH_SIZE, SPLIT_SEED
from setframe.functions.hashing import order_key
from setframe.operators.ordering import numbered_by_key

# Positions that one row lists at a time.
REPEATS = 10_000


def batch_plan(df: DataFrame, kind: str, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Per kind of row: its count, its share of a batch (floor and ceil) and steps per epoch."""
    counts = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()
    share = F.col("n_rows") / total * F.lit(batch_size)
    return counts.select(
        kind, "n_rows",
        F.floor(share).cast("int").alias("batch_rows"),
        F.ceil(share).cast("int").alias("batch_rows_ceil"),
        F.floor(total / F.lit(batch_size)).cast("bigint").alias("steps"))


def plan_lookup(plan: DataFrame, kind: str) -> dict[str, tuple[int, int, int]]:
    """``kind -> (n_rows, batch_rows, steps)``; the plan has one row per kind (two in all)."""
    return {r[kind]: (r["n_rows"], r["batch_rows"], r["steps"]) for r in plan.collect()}


def _by_kind(plan: dict[str, tuple[int, int, int]], kind: str, field: int) -> Column:
    value = F.lit(None).cast("bigint")
    for key, entry in plan.items():
        value = F.when(F.col(kind) == F.lit(key), F.lit(entry[field])).otherwise(value)
    return value


def mixed_batches(df: DataFrame, unit: str, kind: str, batch_size: int = BATCH_SIZE,
                  seed: int = SPLIT_SEED) -> DataFrame:
    """Assign every row a ``batch_id``, ``slot`` and ``in_epoch`` flag.

    Batch ``b`` holds rows ``b*k .. (b+1)*k-1`` of each kind in seeded order, ``k`` being the
    kind's share. Shares are rounded down, so some rows fall into batches past the epoch's last
    step; they are kept and flagged, not dropped.
    """
    plan = plan_lookup(batch_plan(df, kind, batch_size), kind)
    ranked = _ranked(df, unit, kind, len(plan), seed)
    share = F.greatest(_by_kind(plan, kind, 1), F.lit(1))
    place = F.col("_rank") - 1
    batch = F.floor(place / share)
    return ranked.select(*df.columns, batch.alias("batch_id"),
                         (place % share).alias("slot"),
                         (batch < _by_kind(plan, kind, 2)).alias("in_epoch"))


def cyclic_batches(df: DataFrame, unit: str, kind: str, epochs: float,
                   batch_size: int = BATCH_SIZE, seed: int = SPLIT_SEED) -> DataFrame:
    """The endless batch sequence, the first ``epochs`` of it: each kind restarts when used up.

    A row with place ``r`` among the ``n`` of its kind appears at positions ``r, r+n, r+2n, ...``.
    Each row lists its own positions, ``REPEATS`` at a time, so no join against a table of slots is
    needed. Every kind has at least one row in a batch, as in :func:`mixed_batches`.
    """
    plan = plan_lookup(batch_plan(df, kind, batch_size), kind)
    ranked = _ranked(df, unit, kind, len(plan), seed)
    n_batches = ceil(epochs * max((steps for _, _, steps in plan.values()), default=0))
    count, share = _by_kind(plan, kind, 0), F.greatest(_by_kind(plan, kind, 1), F.lit(1))
    place = F.col("_rank") - 1
    last = share * F.lit(n_batches) - 1
    reached = ranked.where(place <= last)
    stretch = count * F.lit(REPEATS)
    starts = reached.select("*", share.alias("_share"), count.alias("_count"), last.alias("_last"),
                            F.explode(F.sequence(place, last, stretch)).alias("_start"))
    stop = F.least(F.col("_last"), F.col("_start") + F.col("_count") * F.lit(REPEATS - 1))
    at = starts.select(*df.columns, "_share",
                       F.explode(F.sequence("_start", stop, "_count")).alias("_at"))
    return at.select(*df.columns, F.floor(F.col("_at") / F.col("_share")).alias("batch_id"),
                     (F.col("_at") % F.col("_share")).alias("slot"))


def _ranked(df: DataFrame, unit: str, kind: str, n_kinds: int, seed: int) -> DataFrame:
    keyed = df.withColumn("_key", order_key(F.col(unit), seed))
    return numbered_by_key(keyed, "_key", unit, [kind], n_kinds, name="_rank")
