"""Training job: pooled features, class weights, a distributed multinomial fit, a report."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.config import N_CLASSES, DatasetConfig
from setframe.functions.labels import argmax
from setframe.operators import descent, linear, scoring, training
from setframe.operators.assemble import pooled_features
from setframe.operators.descent import Descent
from setframe.session import materialise


def train(rows: DataFrame, config: DatasetConfig, split: str = "split",
          max_iter: int = 50) -> tuple[PipelineModel, DataFrame]:
    """Fit on ``split = 'train'``; the second result is loss and accuracy of every split."""
    pooled, names = pooled_features(rows, config, [split, config.label, config.weight])
    weighted = training.with_class_weight(pooled, config.label, config.weight)
    stored = materialise(weighted, "training")
    model = training.fit_classifier(stored.where(F.col(split) == "train"), names, config.label,
                                    "train_weight", max_iter)
    scored = training.predict(model, stored).withColumn("pred", argmax(F.col("scores")))
    report = scoring.loss_and_accuracy(scored, F.col("scores"), F.col(config.label),
                                       F.col("pred"), F.col(config.weight), [split])
    return model, report


def fit(rows: DataFrame, config: DatasetConfig, unit: str, out: str, options: Descent | None = None,
        split: str = "split", background: str = "is_fake") -> DataFrame:
    """Gradient descent over mixed batches of ``split = 'train'``, validated on ``'val'`` after every
    epoch; the run's history. ``out`` is the run's folder: the same one again resumes it.

    Models are under ``out/weights``; :func:`newest` finds the best of the latest run.
    """
    options = options or Descent()
    keep = [unit, split, background, config.label, config.weight]
    pooled, names = pooled_features(rows, config, keep)
    return fit_pooled(training.with_class_weight(pooled, config.label, config.weight), names, unit, out,
                      config.label, "train_weight", config.weight, options, split, background)


def fit_pooled(weighted: DataFrame, features: list[str], unit: str, out: str, label: str,
               train_weight: str, weight: str, options: Descent, split: str = "split",
               background: str = "is_fake") -> DataFrame:
    """The same from one number per feature and a training weight."""
    stored = materialise(weighted, "training")
    counts = {r[label]: r["n"] for r in stored.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    priors = [counts.get(c, 0) / total if total else 0.0 for c in range(N_CLASSES)]
    batches = descent.write_batches(stored.where(F.col(split) == "train"), unit, background,
                                    options.steps)
    return descent.fit_epochs(batches, stored.where(F.col(split) == "val"), features, label,
                              train_weight, F.col(weight), priors, out, options)


def newest(spark: SparkSession, runs: str) -> linear.LinearModel:
    """The best model of the run that wrote last under the folder ``runs``."""
    return linear.load_newest(spark, f"{runs}/*/weights/*/part-*.parquet")
