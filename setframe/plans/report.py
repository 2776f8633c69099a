"""Evaluation tables behind the usual plots: curves, matrices and working-point summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setframe.config import N_CLASSES, WORKING_POINTS
from setframe.functions.labels import argmax, drop_background, onehot
from setframe.operators import confusion, roc
from setframe.operators.sets import side_by_side
from setframe.session import broadcast_bounded


def curve_counts(df: DataFrame, classifiers: Mapping[str, Column], is_signal: Column,
                 weight: Column) -> DataFrame:
    """Running score counts of every classifier on the same rows, in one shuffle."""
    rows = side_by_side(df.select("*", is_signal.alias("_truth"), weight.alias("_weight")),
                        classifiers, ["_truth", "_weight"])
    return roc.score_counts(rows, F.col("score"), F.col("_truth"), F.col("_weight"),
                            ["classifier"], len(classifiers))


def signal_class_decode(scores: Column, label: Column, n_classes: int = N_CLASSES
                        ) -> tuple[Column, Column]:
    """Predicted and true class with the background class removed from both vectors.

    A background row has an all-zero truth vector after the removal and decodes to class 0, as
    the first-index rule of argmax has it.
    """
    return (argmax(drop_background(scores, n_classes)),
            argmax(drop_background(onehot(label, n_classes), n_classes)))


def working_point_matrices(df: DataFrame, classifiers: Mapping[str, Column], scores: Column,
                           label: Column, weight: Column, points: DataFrame,
                           n_classes: int = N_CLASSES) -> DataFrame:
    """Signal-class confusion matrix of the rows above each cut of each classifier.

    No row is copied for its cuts: it gets the number of cuts that it passes, rows are combined by
    that number into at most ``classifiers x (points + 1) x cells`` sums, and each of those counts for
    all the cuts up to its own.
    """
    pred, truth = signal_class_decode(scores, label, n_classes)
    rows = side_by_side(
        df.select("*", pred.alias("_pred"), truth.alias("_truth"), weight.alias("_weight")),
        classifiers, ["_pred", "_truth", "_weight"])
    cuts: dict[str, set[float]] = {name: set() for name in classifiers}
    listed = [r for r in points.select("classifier", "wp", "cut").collect() if r["cut"] is not None]
    for r in listed:
        cuts[r["classifier"]].add(r["cut"])
    passed = F.lit(0)
    for name, own in cuts.items():
        passed = F.when(F.col("classifier") == name, cuts_below(F.col("score"), sorted(own))).otherwise(passed)
    sums = (rows.groupBy("classifier", passed.alias("_passed"), "_pred", "_truth")
            .agg(F.sum("_weight").alias("_weight")))
    places = df.sparkSession.createDataFrame(
        [(r["classifier"], r["wp"], sorted(cuts[r["classifier"]]).index(r["cut"]) + 1) for r in listed],
        "_name string, wp int, _place int")
    passing = sums.join(broadcast_bounded(places, len(listed)), (F.col("classifier") == F.col("_name"))
                        & (F.col("_passed") >= F.col("_place")))
    return confusion.confusion_matrix(passing, F.col("_pred"), F.col("_truth"), F.col("_weight"),
                                      n_classes - 1, ["classifier", "wp"])


def cuts_below(score: Column, cuts: Sequence[float]) -> Column:
    """How many of the sorted ``cuts`` a score exceeds, by binary search; 0 for a NULL score."""
    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(score > F.lit(float(cuts[middle])), search(middle + 1, high)).otherwise(
            search(low, middle))
    return search(0, len(cuts))


def evaluation_report(df: DataFrame, classifiers: Mapping[str, Column], scores: Column,
                      label: Column, is_signal: Column, weight: Column,
                      efficiencies: Sequence[int] = WORKING_POINTS,
                      n_classes: int = N_CLASSES) -> DataFrame:
    """One row per classifier and working point: cut, pass count, efficiency, rejection, AUC of
    what passes, and the diagonal scores of its signal-class confusion matrix."""
    n = len(classifiers)
    group = ["classifier", "wp"]
    counts = curve_counts(df, classifiers, is_signal, weight)
    # classifiers x efficiencies rows: fixed here so that both uses below see plain literals.
    points = roc.working_points(counts, efficiencies, ["classifier"])
    points = df.sparkSession.createDataFrame(points.collect(), points.schema)
    summary = roc.above_cuts(counts, points, len(efficiencies), ["classifier"], n)
    matrices = working_point_matrices(df, classifiers, scores, label, weight, points, n_classes)
    diagonal = confusion.diagonal_score(confusion.normalised(matrices, group), n_classes - 1,
                                        group)
    return summary.join(broadcast_bounded(diagonal, n * len(efficiencies)), group, "left")
