"""Combining row sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_classes(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts, matched by column name."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def split_coverage(whole: DataFrame, parts: Mapping[str, DataFrame], unit: str) -> DataFrame:
    """One row that proves (or not) that the parts are disjoint and complete.

    Units of the whole and of each part are counted together in one combinable aggregation, which
    replaces two set differences and a join.
    """
    tagged = whole.select(unit, F.lit(1).alias("_in_whole"), F.lit(0).alias("_in_parts"))
    for part in parts.values():
        tagged = tagged.unionAll(part.select(unit, F.lit(0), F.lit(1)))
    per_unit = tagged.groupBy(unit).agg(F.sum("_in_whole").alias("w"), F.sum("_in_parts").alias("p"))
    return per_unit.agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("n_whole"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_parts"),
        F.count_if((F.col("w") > 0) & (F.col("p") == 0)).alias("n_missing"),
        F.count_if((F.col("w") == 0) & (F.col("p") > 0)).alias("n_extra"),
        F.count_if(F.col("p") > 1).alias("n_overlap"))


def side_by_side(df: DataFrame, scores: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per classifier: ``(keep..., classifier, score)``."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(name).alias("classifier"), score.cast("double").alias("score"))
        for name, score in scores.items()])))


def with_slices(df: DataFrame, slices: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per slice the record belongs to: ``(keep..., slice)``."""
    names = F.array(*[F.when(inside, F.lit(name)) for name, inside in slices.items()])
    return df.select(*keep, F.explode(F.array_compact(names)).alias("slice"))
