"""Weighted multinomial training, and summaries of a training history."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.operators.scoring import row_loss
from setframe.operators.stats import class_counts, class_weights
from setframe.session import broadcast_if_small


def with_class_weight(df: DataFrame, label: str, weight: str | None = None,
                      name: str = "train_weight") -> DataFrame:
    """Balanced class weight times the row weight; rows without a class stay, with weight 0."""
    weights = class_weights(class_counts(df, label), label).select(
        F.col(label).alias("_class"), "class_weight")
    row = F.lit(1.0) if weight is None else F.col(weight)
    joined = df.join(broadcast_if_small(weights.where("_class is not null")),
                     df[label] == F.col("_class"), "left")
    weight_of = F.coalesce(F.col("class_weight"), F.lit(0.0)) * row
    return joined.withColumn(name, weight_of).drop("_class", "class_weight")


def fit_classifier(train: DataFrame, features: Sequence[str], label: str,
                   weight: str, max_iter: int = 50, reg: float = 1e-4) -> PipelineModel:
    """Multinomial logistic regression with row weights; gradients are tree-aggregated.

    Rows without a class take no part in the fit.
    """
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True),
        LogisticRegression(family="multinomial", featuresCol="_features", labelCol=label,
                           weightCol=weight, probabilityCol="_probability",
                           predictionCol="_prediction", maxIter=max_iter, regParam=reg),
    ]
    return Pipeline(stages=stages).fit(train.where(F.col(label).isNotNull()))


def predict(model: PipelineModel, df: DataFrame, name: str = "scores") -> DataFrame:
    scored = model.transform(df).withColumn(name, vector_to_array("_probability"))
    return scored.select(*df.columns, name)


def against_class_shares(scored: DataFrame, scores: Column, label: str, pred: Column, weight: str,
                         group: str, train: str) -> DataFrame:
    """Per group, weighted loss and accuracy of a fit, and those of a model that knows only the weighted
    class shares of the group ``train``: ``prior_loss`` and ``majority_share``.

    ``beats_shares`` asks for a lower loss and a higher accuracy, both by more than rounding. A class
    that ``train`` lacks makes ``prior_loss`` infinite.
    """
    classes = scored.where(F.col(label).isNotNull()).groupBy(group, label).agg(
        F.sum(weight).alias("w"), F.sum(F.col(weight) * row_loss(scores, F.col(label))).alias("loss"),
        F.sum(F.when(pred == F.col(label), F.col(weight)).otherwise(0.0)).alias("right"))
    # One row for each class; the shares are one small map.
    known = classes.where(F.col(group) == train).agg(
        F.map_from_entries(F.collect_list(F.struct(label, "w")))).first()[0]
    total = sum(known.values())
    largest = max(known, key=lambda c: (known[c], -c), default=None)
    share_loss = F.lit(float("inf"))
    for c, w in known.items():
        share_loss = F.when(F.col(label) == c, -math.log(w / total) if w else float("inf")).otherwise(
            share_loss)
    table = classes.groupBy(group).agg(
        (F.sum("loss") / F.sum("w")).alias("weighted_loss"),
        (F.sum("right") / F.sum("w")).alias("weighted_accuracy"),
        (F.sum(F.col("w") * share_loss) / F.sum("w")).alias("prior_loss"),
        (F.sum(F.when(F.col(label) == largest, F.col("w")).otherwise(0.0))
         / F.sum("w")).alias("majority_share"))
    return table.withColumn("beats_shares",
                            (F.col("weighted_loss") < F.col("prior_loss") - 1e-9)
                            & (F.col("weighted_accuracy") > F.col("majority_share") + 1e-9))


def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch",
               loss: str = "val_loss", carry: Sequence[str] = ("val_acc",)) -> DataFrame:
    """Per run, the epoch with the lowest validation loss; the earliest wins a tie."""
    best = F.min(F.struct(loss, epoch, *carry)).alias("_best")
    return history.groupBy(run).agg(best).select(
        run, *[F.col("_best")[c].alias(c) for c in (epoch, loss, *carry)])


def best_checkpoints(history: DataFrame, run: str = "run", epoch: str = "epoch",
                     loss: str = "val_loss") -> DataFrame:
    """Epochs whose validation loss is below every earlier one (what keep-best would save).

    A run's partition holds its epochs only, some hundreds of rows.
    """
    earlier = (Window.partitionBy(run).orderBy(epoch)
               .rowsBetween(Window.unboundedPreceding, -1))
    lowest: Column = F.min(loss).over(earlier)
    marked = history.withColumn("_lowest", lowest)
    return marked.where(F.col("_lowest").isNull() | (F.col(loss) < F.col("_lowest"))) \
        .drop("_lowest")
