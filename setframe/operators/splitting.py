"""Deterministic splits, shuffles, chunks and contiguous parts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.config import SPLIT_SEED, TEST_SPLIT, VAL_SPLIT
from setframe.functions.hashing import below_fraction, key_bucket, order_key
from setframe.operators.ordering import (BUCKET, hash_digits, numbered_by_key,
                                         numbered_by_value)
from setframe.session import broadcast_bounded


def hash_split(df: DataFrame, unit: str, test: float = TEST_SPLIT, val: float = VAL_SPLIT,
               seed: int = SPLIT_SEED, name: str = "split") -> DataFrame:
    """Test/val/train by a digest of ``unit`` (a file, usually). A pure projection: no shuffle.

    Shares are approximate; ``val`` is a share of what is left after the test rows.
    """
    in_test = below_fraction(order_key(F.col(unit), f"{seed}-test"), test)
    in_val = below_fraction(order_key(F.col(unit), f"{seed}-val"), val)
    return df.withColumn(name, F.when(in_test, "test").when(in_val, "val").otherwise("train"))


def exact_split(df: DataFrame, unit: str, group: Sequence[str] = (),
                max_groups: int | None = 1, test: float = TEST_SPLIT, val: float = VAL_SPLIT,
                seed: int = SPLIT_SEED, name: str = "split") -> DataFrame:
    """Split with exact sizes ``ceil(test * n)`` and ``ceil(val * (n - n_test))`` per group.

    ``df`` has one row per unit. Units are taken in seeded digest order.
    """
    keyed = df.withColumn("_key", order_key(F.col(unit), seed))
    ranked = numbered_by_key(keyed, "_key", unit, group, max_groups, name="_rank", total="_total")
    n_test = F.ceil(F.col("_total") * F.lit(test))
    n_val = F.ceil((F.col("_total") - n_test) * F.lit(val))
    split = (F.when(F.col("_rank") <= n_test, "test")
             .when(F.col("_rank") <= n_test + n_val, "val").otherwise("train"))
    return ranked.withColumn(name, split).drop("_key", "_rank", "_total")


def shuffled_positions(df: DataFrame, unit: str, seed: int = SPLIT_SEED,
                       name: str = "position") -> DataFrame:
    """0-based place of each row in a seeded shuffle."""
    keyed = df.withColumn("_key", order_key(F.col(unit), seed))
    ranked = numbered_by_key(keyed, "_key", unit, name="_rank")
    return ranked.withColumn(name, F.col("_rank") - 1).drop("_key", "_rank")


def contiguous_parts(df: DataFrame, order: str, n_parts: int, name: str = "part",
                     unit: str | None = None) -> DataFrame:
    """Cut an ordered table into ``n_parts`` contiguous parts (0-based), longer parts first.

    Equal to ``ntile(n_parts) - 1`` over the whole table, but computed from distributed row
    numbers instead of one global window. ``unit`` orders (and spreads) rows of equal value.
    """
    ranked = numbered_by_value(df, order, name="_rank", total="_total", unit=unit)
    place = F.col("_rank") - 1
    size = F.floor(F.col("_total") / F.lit(n_parts))
    extra = F.col("_total") % F.lit(n_parts)
    in_long = extra * (size + 1)
    part = F.when(place < in_long, F.floor(place / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(place - in_long, size)))
    return ranked.withColumn(name, part.cast("int")).drop("_rank", "_total")


def chunk_ids(df: DataFrame, order: str, rows_per_chunk: int, group: str | None = None,
              rows_by_group: Mapping[str, int] | None = None, max_groups: int | None = None,
              name: str = "chunk", unit: str | None = None) -> DataFrame:
    """Number consecutive runs of N rows (per source, with per-source N). ``unit`` orders (and spreads)
    rows of equal value.

    This is the logical form, for when the chunk id itself is needed. To only write files of at
    most N rows use ``sources.sinks.write_chunks``, which needs no ordering and no shuffle.
    """
    groups = [] if group is None else [group]
    ranked = numbered_by_value(df, order, groups, 1 if group is None else max_groups,
                               name="_rank", unit=unit)
    size: Column = F.lit(rows_per_chunk)
    for key, n in (rows_by_group or {}).items():
        size = F.when(F.col(group) == F.lit(key), F.lit(n)).otherwise(size)
    return ranked.withColumn(name, F.floor((F.col("_rank") - 1) / size).cast("int")).drop("_rank")


def sample_units(df: DataFrame, unit: str, k: int, seed: int = SPLIT_SEED) -> DataFrame:
    """``k`` units without replacement: the first ``k`` in seeded digest order."""
    return df.withColumn("_key", order_key(F.col(unit), seed)).orderBy("_key", unit) \
        .limit(k).drop("_key")


def permute_columns(df: DataFrame, columns: Sequence[str], unit: str, seed: int = SPLIT_SEED,
                    suffix: str = "_permuted") -> DataFrame:
    """Give every row the ``columns`` of another row: one random cyclic permutation of the table.

    In seeded digest order each row takes the values of its successor and the last row those of
    the first. Inside a digest bucket that is ``lead``; a bucket's last row takes the head of the
    next occupied bucket, from a table of one row per bucket. All columns share the permutation,
    so any number of features costs one shuffle of the rows, and no row is matched with itself as
    long as the table has two rows.
    """
    digits = hash_digits(df.sparkSession)
    keyed = df.withColumn("_key", order_key(F.col(unit), seed))
    keyed = keyed.withColumn(BUCKET, key_bucket(F.col("_key"), digits))
    taken = F.struct(*columns)
    # The lowest key of each bucket comes from narrow integer minima (a hash aggregation that
    # reads only ``unit``); just the rows holding it are then looked up with all their columns.
    prefix = F.conv(F.substring("_key", 1, 15), 16, 10).cast("bigint")
    lowest = keyed.groupBy(BUCKET).agg(F.min(prefix).alias("_lowest")).select(
        F.col(BUCKET).alias("_l_bucket"), "_lowest")
    firsts = keyed.join(broadcast_bounded(lowest, 16 ** digits),
                        (F.col(BUCKET) == F.col("_l_bucket")) & (prefix == F.col("_lowest")))
    heads = firsts.groupBy(BUCKET).agg(F.min_by(taken, F.struct("_key", unit)).alias("_head"))
    by_bucket = Window.orderBy(BUCKET)
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_heads = heads.select(
        F.col(BUCKET).alias("_o_bucket"),
        F.coalesce(F.lead("_head").over(by_bucket), F.first("_head").over(whole)).alias("_next"))
    joined = keyed.join(broadcast_bounded(next_heads, 16 ** digits),
                        F.col(BUCKET) == F.col("_o_bucket"))
    in_bucket = Window.partitionBy(BUCKET).orderBy("_key", unit)
    donor = F.coalesce(F.lead(taken).over(in_bucket), F.col("_next"))
    donated = joined.withColumn("_donor", donor)
    return donated.select(*df.columns, *[F.col("_donor")[c].alias(f"{c}{suffix}")
                                         for c in columns])
