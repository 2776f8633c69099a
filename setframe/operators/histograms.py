"""Histograms and histogram-ratio reweighting.

Bins are computed per row and combined before the shuffle, so what moves is at most
``partitions x features x bins`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.config import CONTROL_BINS, REWEIGHT_BINS, REWEIGHT_RANGE
from setframe.functions.binning import bin_edges, equal_width_bin
from setframe.operators.grids import fill_grid
from setframe.session import broadcast_bounded, materialise


def fixed_histogram(df: DataFrame, value: str, n_bins: int = REWEIGHT_BINS,
                    value_range: tuple[float, float] = REWEIGHT_RANGE,
                    weight: Column | None = None) -> DataFrame:
    """``(bin, lo, hi, value)`` for every bin; values outside the range are not counted."""
    lo, hi = value_range
    measure = F.count(F.lit(1)) if weight is None else F.sum(weight)
    binned = df.groupBy(equal_width_bin(F.col(value), lo, hi, n_bins).alias("bin")).agg(
        measure.alias("value"))
    return _with_edges(fill_grid(binned, "bin", n_bins, ["value"]), lo, hi, n_bins, ["value"])


def ratio_histogram(df: DataFrame, value: str, background: Column,
                    n_bins: int = REWEIGHT_BINS,
                    value_range: tuple[float, float] = REWEIGHT_RANGE,
                    weight: Column | None = None) -> DataFrame:
    """Signal / background per bin, both counted in the same pass. Empty background gives 0."""
    lo, hi = value_range
    one = F.lit(1.0) if weight is None else weight
    binned = (df.select(equal_width_bin(F.col(value), lo, hi, n_bins).alias("bin"),
                        background.alias("_bg"), one.alias("_w"))
              .groupBy("bin").agg(
                  F.sum(F.when(~F.col("_bg"), F.col("_w")).otherwise(0.0)).alias("signal"),
                  F.sum(F.when(F.col("_bg"), F.col("_w")).otherwise(0.0)).alias("background")))
    filled = fill_grid(binned, "bin", n_bins, ["signal", "background"])
    ratio = F.when(F.col("background") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("signal"), F.col("background")))
    return _with_edges(filled.withColumn("value", ratio), lo, hi, n_bins,
                       ["signal", "background", "value"])


def apply_reweight(df: DataFrame, value: str, background: Column, histogram: DataFrame,
                   n_bins: int = REWEIGHT_BINS,
                   value_range: tuple[float, float] = REWEIGHT_RANGE,
                   name: str = "pt_reweight") -> DataFrame:
    """Background rows take the histogram value of their bin; signal and out-of-range rows 1."""
    lo, hi = value_range
    lookup = histogram.select(F.col("bin").alias("_hist_bin"), F.col("value").alias("_hist_value"))
    binned = df.withColumn("_bin", equal_width_bin(F.col(value), lo, hi, n_bins))
    joined = binned.join(broadcast_bounded(lookup, n_bins),
                         F.col("_bin") == F.col("_hist_bin"), "left")
    weight = F.when(background, F.coalesce(F.col("_hist_value"), F.lit(1.0))).otherwise(1.0)
    return joined.withColumn(name, weight).drop("_bin", "_hist_bin", "_hist_value")


def reweight_closure(df: DataFrame, value: str, background: Column, weight: str,
                     n_bins: int = REWEIGHT_BINS,
                     value_range: tuple[float, float] = REWEIGHT_RANGE) -> DataFrame:
    """Per occupied bin: signal sum, reweighted background sum, and their difference."""
    lo, hi = value_range
    return (df.select(equal_width_bin(F.col(value), lo, hi, n_bins).alias("bin"),
                      background.alias("_bg"), F.col(weight).alias("_w"))
            .where(F.col("bin").isNotNull())
            .groupBy("bin").agg(
                F.sum(F.when(~F.col("_bg"), F.col("_w")).otherwise(0.0)).alias("signal"),
                F.sum(F.when(F.col("_bg"), F.col("_w")).otherwise(0.0)).alias("background"))
            .withColumn("difference", F.col("signal") - F.col("background")))


def auto_histograms(df: DataFrame, columns: Sequence[str], n_bins: int = CONTROL_BINS,
                    pad: float | None = None, group: Sequence[str] = (),
                    max_groups: int | None = None) -> DataFrame:
    """Histogram of every column over its own min..max: ``(group..., feature, bin, lo, hi, n)``.

    Pass one takes all ranges at once, one row for each group. In pass two a record lists one integer
    for each column, its place among all columns' bins, and those are counted before the shuffle: at
    most ``tasks x groups x columns x bins`` small rows move. Only occupied bins are listed. Pads,
    NULLs, NaN and infinities are left out, of the ranges too.
    """
    def usable(c: str) -> str:
        x = f"cast(`{c}` as double)"
        x = x if pad is None else f"nullif({x}, {float(pad)!r}D)"
        return f"if(abs({x}) < double('Infinity'), {x}, null)"

    # A column of one value gets a range of width one around it.
    spread = df.groupBy(*group).agg(*[
        F.expr(f"{f}({usable(c)})").alias(f"_{f}_{i}")
        for i, c in enumerate(columns) for f in ("min", "max")])
    ranges = spread.select(*[F.col(g).alias(f"_r_{g}") for g in group], *[
        F.expr(f"_{f}_{i} {sign} if(_min_{i} = _max_{i}, 0.5D, 0D)").alias(f"_{end}_{i}")
        for i in range(len(columns)) for f, sign, end in (("min", "-", "lo"), ("max", "+", "hi"))])
    ends = [f"_{end}_{i}" for i in range(len(columns)) for end in ("lo", "hi")]
    if group:
        condition = F.lit(True)
        for g in group:
            condition = condition & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
        # Without a bound on the groups no broadcast is asked for.
        ranges = materialise(ranges, "ranges")
        ranged = df.join(broadcast_bounded(ranges, max_groups), condition)
    else:
        row = ranges.first()  # two numbers for each column
        ranged = df.withColumns({e: F.lit(row[e]).cast("double") for e in ends})
        ranges = df.sparkSession.createDataFrame([tuple(row)], ranges.schema)
    places = [F.lit(i * n_bins) + equal_width_bin(F.expr(usable(c)), F.col(f"_lo_{i}"), F.col(f"_hi_{i}"),
                                                  n_bins, True) for i, c in enumerate(columns)]
    counted = (ranged.select(*group, F.explode(F.array(*places)).alias("_place"))
               .groupBy(*group, "_place").agg(F.count(F.lit(1)).alias("n")).where("_place is not null"))
    by_column = ranges.select(*[f"_r_{g}" for g in group], F.posexplode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"_lo_{i}").alias("lo"), F.col(f"_hi_{i}").alias("hi"))
        for i, c in enumerate(columns)])).alias("_column", "_r"))
    same = F.floor(F.col("_place") / F.lit(n_bins)) == F.col("_column")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_r_{g}"))
    groups = 1 if not group else max_groups
    bound = None if groups is None else len(columns) * groups
    named = counted.join(broadcast_bounded(by_column, bound), same).select(
        *group, "_r.*", (F.col("_place") % F.lit(n_bins)).alias("bin"), "n")
    low, high = bin_edges(F.col("bin"), F.col("lo"), F.col("hi"), n_bins)
    return named.select(*group, "feature", "bin", low.alias("lo"), high.alias("hi"), "n")


def _with_edges(filled: DataFrame, lo: float, hi: float, n_bins: int,
                values: Sequence[str]) -> DataFrame:
    low, high = bin_edges(F.col("bin"), lo, hi, n_bins)
    return filled.select("bin", low.alias("lo"), high.alias("hi"), *values)
