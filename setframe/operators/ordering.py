"""Global order without a single-task window.

``Window.orderBy`` with no partition sends the whole table to one task. Every operator here uses
two levels instead: rows are assigned to an order-preserving bucket, bucket totals (a table of at
most ``groups x buckets`` rows) are prefix-summed, and the window runs inside each bucket.

The bucket is a deterministic expression of the row itself - a digest prefix, or a position among
quantiles that were read once on the driver - so both uses of the table, and a task re-run after
an executor loss, agree on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setframe.config import SPLIT_SEED
from setframe.functions.hashing import key_bucket, order_key
from setframe.session import broadcast_bounded, materialise

MIN_BUCKETS = 8
MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 1_000_000
MAX_VALUE_BUCKETS = 16_384
BUCKET = "_bucket"


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as shuffle partitions, within fixed limits. Never changes a result."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_BUCKETS, max(MIN_BUCKETS, wanted))


def hash_digits(spark: SparkSession) -> int:
    """Digest prefix length giving a few buckets per shuffle partition (at most 16 ** 4)."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digits = 1
    while 16 ** digits < 2 * wanted and digits < 4:
        digits += 1
    return digits


def with_range_bucket(df: DataFrame, column: str, n_buckets: int,
                      name: str = BUCKET) -> DataFrame:
    """Add an integer bucket that grows with ``column``; equal values share a bucket.

    Split points come from one quantile-sketch pass over that column alone. The sketch is merged
    from per-partition summaries and its size depends only on ``n_buckets``.
    """
    return _bucketed(df, column, sorted(set(_quantile_cuts(df, column, n_buckets))), name)


def _quantile_cuts(df: DataFrame, column: str, n_buckets: int) -> list[float]:
    """Values that cut a column into parts of about equal size; a value that holds several parts
    comes several times."""
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    return df.approxQuantile(column, probabilities, 1.0 / (4 * n_buckets))


def _bucketed(df: DataFrame, column: str, cuts: Sequence[float], name: str) -> DataFrame:
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep")
    return bucketizer.transform(df).withColumn(name, F.col(name).cast("int"))


def row_numbers(df: DataFrame, order: Sequence[str | Column], bucket: str, n_buckets: int,
                group: Sequence[str] = (), max_groups: int | None = 1,
                name: str = "row_number", total: str | None = None) -> DataFrame:
    """1-based row number in ``order`` within ``group``, for groups of any size.

    ``bucket`` must not decrease along ``order``. A group holding most of the table is still
    spread over all its buckets. ``max_groups`` is the caller's bound on the number of groups; it
    decides whether the offsets may be broadcast.
    """
    keys = [*group, bucket]
    before = (Window.partitionBy(*group).orderBy(bucket)
              .rowsBetween(Window.unboundedPreceding, -1))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    columns = [F.col(k).alias(f"_o_{k}") for k in keys]
    columns.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if total is not None:
        columns.append(F.sum("_n").over(Window.partitionBy(*group)).alias(total))
    offsets = sizes.select(*columns)
    bound = None if max_groups is None else max_groups * n_buckets
    joined = _attach(df, offsets, keys, bound)
    within = Window.partitionBy(*keys).orderBy(*order)
    numbered = joined.withColumn(name, F.col("_offset") + F.row_number().over(within))
    return numbered.drop("_offset", *[f"_o_{k}" for k in keys])


def numbered_by_key(df: DataFrame, key: str, tie_break: str, group: Sequence[str] = (),
                    max_groups: int | None = 1, name: str = "row_number",
                    total: str | None = None) -> DataFrame:
    """Row numbers in the order of a digest column (see ``functions.hashing.order_key``)."""
    digits = hash_digits(df.sparkSession)
    bucketed = df.withColumn(BUCKET, key_bucket(F.col(key), digits))
    return row_numbers(bucketed, [key, tie_break], BUCKET, 16 ** digits, group, max_groups,
                       name, total).drop(BUCKET)


def numbered_by_value(df: DataFrame, column: str, group: Sequence[str] = (),
                      max_groups: int | None = 1, name: str = "row_number",
                      total: str | None = None, unit: str | None = None,
                      seed: int = SPLIT_SEED) -> DataFrame:
    """Row numbers in the order of a numeric column.

    Equal values are numbered in the digest order of ``unit``, which identifies a row; without one
    their order is open and a value's rows stay together. With it, a value that holds more than a
    bucket's share of the table is spread over digest buckets of its own.
    """
    n = default_buckets(df.sparkSession)
    if unit is None:
        bucketed = with_range_bucket(df, column, n)
        return row_numbers(bucketed, [column], BUCKET, n + 1, group, max_groups, name,
                           total).drop(BUCKET)
    cuts = _quantile_cuts(df, column, n)
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    digits = hash_digits(df.sparkSession)
    inner = 16 ** digits + 1
    keyed = df.withColumn("_tie", order_key(F.col(unit), seed))
    bucketed = _bucketed(keyed, column, sorted(set(cuts)), BUCKET)
    # A hot value is a cut, so its bucket begins with it: digest buckets first, then larger values.
    is_hot = F.col(column).isin(hot) if hot else F.lit(False)
    place = F.when(is_hot, F.conv(key_bucket(F.col("_tie"), digits), 16, 10).cast("int")).otherwise(
        F.lit(inner - 1))
    bucketed = bucketed.withColumn(BUCKET, (F.col(BUCKET) * inner + place).cast("int"))
    return row_numbers(bucketed, [column, "_tie", unit], BUCKET, n + 1 + len(hot) * inner, group,
                       max_groups, name, total).drop(BUCKET, "_tie")


def cumulative_sums(df: DataFrame, order: str, sums: Mapping[str, Column],
                    group: Sequence[str] = (), max_groups: int | None = 1) -> DataFrame:
    """One row per distinct ``order`` value (ascending) with its sums and the sums before it.

    For each name ``x`` in ``sums`` the result has ``x`` (at this value), ``x_before`` (over all
    smaller values) and ``x_total`` (over the group). Rows are combined by value before anything
    is ordered, so a value shared by a large part of the table is one row by then. The combined
    table is written out: the input is read once, and the bucket count follows the real size.
    """
    combined = materialise(df.groupBy(*group, order).agg(*[c.alias(x) for x, c in sums.items()]),
                           "combined")
    n = min(MAX_VALUE_BUCKETS, -(-combined.count() // ROWS_PER_BUCKET))
    if n <= 1:
        return _cumulative_small(combined, order, list(sums), group)
    bucketed = with_range_bucket(combined, order, n)
    keys = [*group, BUCKET]
    before_bucket = (Window.partitionBy(*group).orderBy(BUCKET)
                     .rowsBetween(Window.unboundedPreceding, -1))
    in_group = Window.partitionBy(*group)
    sizes = bucketed.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in sums])
    offsets = sizes.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(x).over(before_bucket), F.lit(0)).alias(f"_off_{x}") for x in sums],
        *[F.sum(x).over(in_group).alias(f"{x}_total") for x in sums])
    bound = None if max_groups is None else max_groups * (n + 1)
    joined = _attach(bucketed, offsets, keys, bound)
    earlier = (Window.partitionBy(*keys).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, -1))
    inside = joined.select("*", *[F.sum(x).over(earlier).alias(f"_in_{x}") for x in sums])
    return inside.selectExpr(
        *group, order, *sums,
        *[f"_off_{x} + coalesce(_in_{x}, 0) as {x}_before" for x in sums],
        *[f"{x}_total" for x in sums])


def _cumulative_small(combined: DataFrame, order: str, sums: Sequence[str],
                      group: Sequence[str]) -> DataFrame:
    """The same for a table that was counted and fits one bucket: a window per group will do."""
    in_group = Window.partitionBy(*group)
    earlier = in_group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return combined.select(
        *group, order, *sums,
        *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in sums],
        *[F.sum(x).over(in_group).alias(f"{x}_total") for x in sums])


def percentiles(counts: DataFrame, value: str, n: str, percents: Sequence[float],
                group: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Exact linear-interpolation percentiles, ``(group..., percentiles)`` with a map column.

    ``counts`` comes from :func:`cumulative_sums` and ``n`` names one of its row counts (rows may
    have a count of zero). The built-in exact ``percentile`` gathers every distinct value of a
    group in one task; here the two neighbouring order statistics of each percent are picked from
    the distributed running counts by conditional maxima.
    """
    low, high, picks = {}, {}, [f"max({n}_total) as _n"]
    for i, p in enumerate(percents):
        position = f"{p / 100.0!r}D * ({n}_total - 1)"
        low[i], high[i] = f"_lo{i}", f"_hi{i}"
        for name, place in ((low[i], f"floor({position})"),
                            (high[i], f"least(floor({position}) + 1, {n}_total - 1)")):
            at = f"({n}_total - 1 - {place})" if descending else place
            picks.append(f"max(case when {n}_before <= {at} and {at} < {n}_before + {n}"
                         f" then {value} end) as {name}")
    picked = counts.groupBy(*group).agg(*[F.expr(e) for e in picks])
    entries = []
    for i, p in enumerate(percents):
        exact = f"{p / 100.0!r}D * (_n - 1)"
        entries.append(f"{float(p)!r}D, {low[i]} + ({exact} - floor({exact}))"
                       f" * ({high[i]} - {low[i]})")
    return picked.select(*group, F.expr(f"map({', '.join(entries)})").alias("percentiles"))


def _attach(df: DataFrame, offsets: DataFrame, keys: Sequence[str],
            row_bound: int | None) -> DataFrame:
    condition = F.lit(True)
    for k in keys:
        condition = condition & df[k].eqNullSafe(offsets[f"_o_{k}"])
    joined = df.join(broadcast_bounded(offsets, row_bound), condition)
    return joined.drop(*[f"_o_{k}" for k in keys])
