"""Feature statistics, class counts and audits. Each is one pass over its input (robust: two)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.config import N_CLASSES, TRIM_SIGMA
from setframe.functions.clean import is_nan, normalise

STATS_SCHEMA = "feature string, mean double, stddev double"


def _long(one_row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn ``{field}_{i}`` columns of one row into one row per column name."""
    rows = ", ".join(
        f"struct('{c}' as feature, {', '.join(f'{f}_{i} as {f}' for f in fields)})"
        for i, c in enumerate(columns))
    return one_row.selectExpr(f"inline(array({rows}))")


def _moments(x: str, i: int) -> list[Column]:
    return [F.expr(f"avg({x})").alias(f"mean_{i}"), F.expr(f"stddev_pop({x})").alias(f"stddev_{i}"),
            F.expr(f"count({x})").alias(f"n_{i}")]


def flatten_lists(df: DataFrame, list_columns: Sequence[str]) -> DataFrame:
    """One row per element of parallel list columns (all of one length per row)."""
    zipped = df.select(F.explode(F.arrays_zip(*list_columns)).alias("_o"))
    return zipped.select(*[F.col("_o")[c].alias(c) for c in list_columns])


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, mean, stddev, n)`` for all columns in one aggregation; population stddev."""
    aggregates = [m for i, c in enumerate(columns) for m in _moments(f"cast(`{c}` as double)", i)]
    return _long(df.agg(*aggregates), columns, ["mean", "stddev", "n"])


def robust_stats(df: DataFrame, columns: Sequence[str], n_sigma: float = TRIM_SIGMA,
                 two_sided: bool = False) -> DataFrame:
    """Mean and stddev recomputed after dropping values ``n_sigma`` above the first mean.

    The first pass is one row for all columns and enters the second as a scalar subquery.
    """
    first = df.agg(F.struct(*[
        F.struct(F.avg(F.col(c).cast("double")).alias("m"),
                 F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(f"c{i}")
        for i, c in enumerate(columns)]).alias("_first")).scalar()
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        offset = x - first[f"c{i}"]["m"]
        if two_sided:
            offset = F.abs(offset)
        kept = F.when(offset < F.lit(float(n_sigma)) * first[f"c{i}"]["s"], x)
        # Nothing lies below zero deviations: a constant column keeps its plain moments.
        aggregates += [
            F.coalesce(F.avg(kept), F.avg(x)).alias(f"mean_{i}"),
            F.coalesce(F.stddev_pop(kept), F.stddev_pop(x)).alias(f"stddev_{i}"),
            F.when(F.count(kept) > 0, F.count(kept)).otherwise(F.count(x)).alias(f"n_{i}")]
    return _long(df.agg(*aggregates), columns, ["mean", "stddev", "n"])


def _folded(column: str, shift: float, kept: str) -> str:
    """Count, sum and sum of squares of the kept elements of one record's list, about ``shift``."""
    y = f"(cast(y as double) - {shift!r}D)"
    return (f"aggregate(`{column}`, named_struct('n', 0L, 's', 0D, 'q', 0D), (a, y) -> if({kept},"
            f" named_struct('n', a.n + 1L, 's', a.s + {y}, 'q', a.q + {y} * {y}), a))")


def _list_moments(folds: Mapping[str, str], shifts: Mapping[str, float]) -> dict[str, list[Column]]:
    """Aggregates ``(mean, stddev, n)`` of folded columns, combined from one row per record."""
    out = {}
    for name, column in folds.items():
        n, s, q = (f"sum({column}.{field})" for field in "nsq")
        out[name] = [F.expr(f"{shifts[name]!r}D + try_divide({s}, {n})"),
                     F.expr(f"sqrt(greatest(try_divide({q} - try_divide({s} * {s}, {n}), {n}), 0D))"),
                     F.expr(f"coalesce({n}, 0L)")]
    return out


def _shifts(df: DataFrame, lists: Sequence[str], rows: int = 1000) -> dict[str, float]:
    """A value of each list column, from its first records; any number near the data will do."""
    some = df.select(*[F.expr(f"try_element_at(filter(transform(`{c}`, y -> cast(y as double)),"
                              f" y -> abs(y) < double('Infinity')), 1)").alias(c) for c in lists])
    found = some.limit(rows).agg(*[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(c) for c in lists])
    row = found.first()
    return {c: float(row[c] or 0.0) for c in lists}


def mixed_stats(df: DataFrame, scalars: Sequence[str], lists: Sequence[str], robust: bool = True,
                n_sigma: float = TRIM_SIGMA, two_sided: bool = False) -> DataFrame:
    """``(feature, mean, stddev, n)`` of scalar columns and of the elements of list columns, all in one
    scan (robust: two), whatever the lengths of a record's lists.

    A record's list is folded to count, sum and sum of squares where it is read, about a value of the
    column, so that large offsets cost no precision; what is aggregated is one row for each record.
    """
    shifts = _shifts(df, lists) if lists else {}

    def pass_over(keep_list, scalar_value) -> DataFrame:
        folds = {c: f"_f{i}" for i, c in enumerate(lists)}
        rows = df.select(*[F.col(f"`{c}`") for c in scalars], *[
            F.expr(_folded(c, shifts[c], keep_list(c))).alias(folds[c]) for c in lists])
        moments = {c: [F.avg(scalar_value(c)), F.stddev_pop(scalar_value(c)), F.count(scalar_value(c))]
                   for c in scalars} | _list_moments(folds, shifts)
        return rows.agg(*[column.alias(f"{field}_{i}") for i, c in enumerate([*scalars, *lists])
                          for field, column in zip(("mean", "stddev", "n"), moments[c], strict=True)])

    columns = [*scalars, *lists]
    first = pass_over(lambda c: "y is not null", lambda c: F.col(f"`{c}`").cast("double"))
    if not robust:
        return _long(first, columns, ["mean", "stddev", "n"])
    found = first.first()  # one row, three numbers for each column
    known = {c: tuple(found[f"{field}_{i}"] for field in ("mean", "stddev", "n"))
             for i, c in enumerate(columns)}

    def inside(c: str, x: str) -> str:
        mean, stddev, _ = known[c]
        if mean is None:
            return "false"
        offset = f"{x} - double('{mean!r}')"
        return f"{f'abs({offset})' if two_sided else offset} < {float(n_sigma)!r}D * double('{stddev!r}')"

    second = pass_over(lambda c: f"y is not null and {inside(c, 'cast(y as double)')}",
                       lambda c: F.expr(f"if({inside(c, f'cast(`{c}` as double)')}, cast(`{c}` as double), null)"))
    # Nothing lies below zero deviations: a constant column keeps its plain moments.
    fields = []
    for i, c in enumerate(columns):
        emptied = F.col(f"n_{i}") == 0
        for field, value, kind in zip(("mean", "stddev", "n"), known[c], ("double", "double", "bigint"),
                                      strict=True):
            fields.append(F.when(emptied, F.lit(value).cast(kind)).otherwise(F.col(f"{field}_{i}"))
                          .alias(f"{field}_{i}"))
    return _long(second.select(*fields), columns, ["mean", "stddev", "n"])


def stats_lookup(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """Stats table as a dict. It has one row per column of the dataset, whatever its row count;
    a column without values has no entry."""
    rows = stats.select("feature", "mean", "stddev").dropna().collect()
    return {r["feature"]: (r["mean"], r["stddev"]) for r in rows}


def normalise_columns(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                      columns: Sequence[str], suffix: str = "_normed") -> DataFrame:
    """Add ``<name>_normed`` for each column that has stats; others are left alone."""
    known = [c for c in columns if c in stats]
    return df.withColumns({f"{c}{suffix}": normalise(F.col(c), *stats[c]) for c in known})


def normalise_lists(df: DataFrame, stats: Mapping[str, tuple[float, float]],
                    columns: Sequence[str], suffix: str = "_normed") -> DataFrame:
    """The list counterpart of :func:`normalise_columns`: every element of every list."""
    from setframe.functions.clean import normalise_array
    known = [c for c in columns if c in stats]
    return df.withColumns({f"{c}{suffix}": normalise_array(F.col(c), *stats[c]) for c in known})


def nan_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n_nan, n_rows)``: NaN or NULL entries per column, one pass."""
    aggregates = []
    for i, c in enumerate(columns):
        aggregates += [F.count_if(is_nan(F.col(c).cast("double"))).alias(f"n_nan_{i}"),
                       F.count(F.lit(1)).alias(f"n_rows_{i}")]
    return _long(df.agg(*aggregates), columns, ["n_nan", "n_rows"])


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def vector_sums(df: DataFrame, vector: Column, n_classes: int = N_CLASSES) -> DataFrame:
    """Element-wise sum of a label vector over all rows: ``(class_index, total)``."""
    sums = [F.sum(F.get(vector, F.lit(i))).alias(f"s{i}") for i in range(n_classes)]
    rows = [F.struct(F.lit(i).alias("class_index"),
                     F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("total"))
            for i in range(n_classes)]
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def class_weights(counts: DataFrame, label: str = "label", n: str = "n") -> DataFrame:
    """Balanced weight ``total / (2 n_c)`` and log prior ``ln(n_c / total)`` per class."""
    total = counts.agg(F.sum(n).cast("double")).scalar()
    share = F.col(n).cast("double")
    return counts.select(
        label, n,
        (F.lit(1.0) / share * (total / F.lit(2.0))).alias("class_weight"),
        F.ln(share / total).alias("log_prior"))


def multiplicity_histogram(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(collection, n_objects, n_rows)`` from one object-count column per collection."""
    long = counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("collection"), F.col(c).cast("bigint").alias("n_objects"))
        for c in columns])))
    return long.groupBy("collection", "n_objects").agg(F.count(F.lit(1)).alias("n_rows"))
