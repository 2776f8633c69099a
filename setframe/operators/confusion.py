"""Weighted confusion matrices in long form ``(group..., pred, truth, weight)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.config import MATRIX_EPSILON, N_CLASSES
from setframe.operators.grids import fill_grid


def confusion_matrix(df: DataFrame, pred: Column, truth: Column, weight: Column | None = None,
                     n_classes: int = N_CLASSES, group: Sequence[str] = ()) -> DataFrame:
    """All ``n x n`` cells. Without a weight every row counts 1; rows without a class, or with one
    outside ``0..n-1``, are left out."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    known = pred.between(0, n_classes - 1) & truth.between(0, n_classes - 1)
    cell = F.when(known, pred * F.lit(n_classes) + truth)
    cells = (df.select(*group, cell.alias("_cell"), w.alias("_w"))
             .groupBy(*group, "_cell").agg(F.sum("_w").alias("weight")))
    filled = fill_grid(cells, "_cell", n_classes * n_classes, ["weight"], group)
    return filled.select(
        *group, F.floor(F.col("_cell") / F.lit(n_classes)).cast("int").alias("pred"),
        (F.col("_cell") % F.lit(n_classes)).cast("int").alias("truth"), "weight")


def normalised(matrix: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of the truth column, of the prediction row, and of the row to two places.

    Windows run over the ``n x n`` cells only.
    """
    by_truth = F.sum("weight").over(Window.partitionBy(*group, "truth"))
    by_pred = F.sum("weight").over(Window.partitionBy(*group, "pred"))
    return matrix.select(
        *group, "pred", "truth", "weight",
        (F.col("weight") / (by_truth + F.lit(MATRIX_EPSILON))).alias("norm_by_truth"),
        (F.col("weight") / (by_pred + F.lit(MATRIX_EPSILON))).alias("norm_by_pred"),
        F.coalesce(F.round(F.try_divide(F.col("weight"), by_pred), 2), F.lit(0.0))
        .alias("norm_by_pred_2dp"))


def diagonal_score(normalised_matrix: DataFrame, n_classes: int = N_CLASSES,
                   group: Sequence[str] = (), drop_first: bool = False) -> DataFrame:
    """Mean of the diagonal for both normalisations; ``drop_first`` leaves class 0 out."""
    cells = normalised_matrix
    if drop_first:
        cells = cells.where((F.col("pred") > 0) & (F.col("truth") > 0))
        n_classes -= 1
    diagonal = F.col("pred") == F.col("truth")
    return cells.groupBy(*group).agg(
        (F.sum(F.when(diagonal, F.col("norm_by_truth"))) / F.lit(n_classes))
        .alias("diag_by_truth"),
        (F.sum(F.when(diagonal, F.col("norm_by_pred"))) / F.lit(n_classes))
        .alias("diag_by_pred"))
