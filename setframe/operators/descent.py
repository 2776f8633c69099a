"""Gradient descent over mixed batches, one Spark job for each step, with a table for each epoch.

A step reads only its batch (batches are partitions of a written table); every task reduces its rows to
one vector of gradient sums, and those vectors are added. The driver holds the model alone. After an
epoch its weights, losses and validation matrix are written as one file of one row; a run that is
started again on the same path goes on after its last complete epoch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from setframe.config import SPLIT_SEED
from setframe.functions.labels import argmax
from setframe.functions.ragged import scalar_vector
from setframe.operators import linear
from setframe.operators.batching import mixed_batches
from setframe.operators.scoring import PROBABILITY_FLOOR, row_loss, to_matrix
from setframe.operators.stats import column_stats, stats_lookup
from setframe.session import scratch_path, ship_package

STD_EPS = 1e-8
EPOCH_SCHEMA = (f"{linear.SCHEMA}, scaled array<array<double>>, velocity array<array<double>>, "
                "loss double, val_loss double, val_accuracy double, val_rows bigint, "
                "confusion array<struct<pred: int, truth: int, weight: double>>")


@dataclass(frozen=True)
class Descent:
    """``steps`` batches make an epoch; ``patience`` epochs without a lower validation loss end it."""

    epochs: int = 10
    steps: int = 10
    rate: float = 0.5
    momentum: float = 0.0
    patience: int | None = None


def write_batches(train: DataFrame, unit: str, kind: str, steps: int, seed: int = SPLIT_SEED
                  ) -> DataFrame:
    """The training rows as ``steps`` class-proportional batches, each a partition of a written table.
    Rows past the last full batch take no part, as in an epoch of :func:`mixed_batches`."""
    spark, n = train.sparkSession, train.count()
    batches = mixed_batches(train, unit, kind, max(1, n // steps), seed)
    path = scratch_path(spark, "batches")
    batches.where(F.col("batch_id") < steps).drop("slot", "in_epoch").write.partitionBy(
        "batch_id").parquet(path)
    schema = batches.drop("slot", "in_epoch", "batch_id").schema.add("batch_id", "long")
    return spark.read.schema(schema).parquet(path)


def _gradient(batch: DataFrame, features: Sequence[str], label: str, weight: str,
              scaled: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Sums over the rows with a class: gradient by (class, feature and bias), then loss and weight."""
    n_classes, width = scaled.shape
    shared = batch.sparkSession.sparkContext.broadcast((scaled, mean, std))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m, s = shared.value
        total = np.zeros(n_classes * width + 2)
        for rows in batches:
            if not rows.num_rows:
                continue
            x = np.hstack([(to_matrix(rows["x"], width - 1) - m) / s, np.ones((rows.num_rows, 1))])
            y = rows["y"].to_numpy(zero_copy_only=False).astype(np.int64)
            weights = rows["w"].to_numpy(zero_copy_only=False)
            z = x @ w.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            at = np.arange(len(y))
            own = np.clip(p[at, y], PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
            p[at, y] -= 1.0
            total[:-2] += ((weights[:, None] * p).T @ x).ravel()
            total[-2] -= weights @ np.log(own)
            total[-1] += weights.sum()
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total), dtype=np.int32), "value": total})

    with_class = batch.where(F.col(label).between(0, n_classes - 1) & F.col(weight).isNotNull())
    sums = (with_class.select(scalar_vector(features).alias("x"), F.col(label).cast("int").alias("y"),
                              F.col(weight).cast("double").alias("w"))
            .mapInArrow(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")))
    out = np.zeros(n_classes * width + 2)
    for row in sums.collect():
        out[row["at"]] = row["value"]
    return out


def _folded(features: Sequence[str], scaled: np.ndarray, mean: np.ndarray, std: np.ndarray
            ) -> linear.LinearModel:
    """Weights on standardised features as a model on plain ones."""
    weights = scaled[:, :-1] / std
    return linear.LinearModel(tuple(features), weights, scaled[:, -1] - weights @ mean)


def validation(model: linear.LinearModel, rows: DataFrame, label: str, weight: Column) -> dict:
    """Weighted loss, accuracy and confusion matrix of the rows with a class, in one aggregation of at
    most ``classes ** 2`` rows."""
    n_classes = len(model.bias)
    scored = model.score(rows.withColumn("_weight", weight), [label, "_weight"])
    cells = (scored.where(F.col(label).between(0, n_classes - 1))
             .select(argmax(F.col("scores")).alias("pred"), F.col(label).cast("int").alias("truth"),
                     "_weight", row_loss(F.col("scores"), F.col(label)).alias("loss"))
             .groupBy("pred", "truth").agg(
                 F.sum("_weight").alias("weight"), F.sum(F.col("_weight") * F.col("loss")).alias("loss"),
                 F.count(F.lit(1)).alias("n"))).collect()
    n = sum(r["n"] for r in cells)
    w = sum(r["weight"] for r in cells)
    found = {(r["pred"], r["truth"]): r["weight"] for r in cells}
    return {"val_loss": sum(r["loss"] for r in cells) / w if w else None,
            "val_accuracy": sum(r["n"] for r in cells if r["pred"] == r["truth"]) / n if n else None,
            "val_rows": n,
            "confusion": [Row(pred=p, truth=t, weight=found.get((p, t), 0.0))
                          for p in range(n_classes) for t in range(n_classes)]}


def history(spark: SparkSession, path: str) -> DataFrame:
    """All complete epochs of a run: ``epoch``, losses, accuracy, the model and its matrix."""
    schema = spark.createDataFrame([], EPOCH_SCHEMA).schema.add("epoch", "integer")
    return spark.read.schema(schema).option("basePath", f"{path}/epochs").parquet(f"{path}/epochs")


def _last_epoch(spark: SparkSession, path: str) -> list[Row]:
    try:
        done = history(spark, path)
    except AnalysisException:  # nothing written yet
        return []
    return sorted(done.select("epoch", "scaled", "velocity", "val_loss").collect(),
                  key=lambda r: r["epoch"])


def fit_epochs(batches: DataFrame, val: DataFrame, features: Sequence[str], label: str, weight: str,
               val_weight: Column, priors: Sequence[float], path: str,
               descent: Descent | None = None) -> DataFrame:
    """Fit a linear softmax classifier and return its :func:`history`.

    ``batches`` holds the training rows with a ``batch_id`` below ``descent.steps``; features are
    standardised by its moments. ``priors`` are the classes' shares, whose logarithms the biases start
    from (a class without rows starts as if it had a billionth). An epoch that lowers the validation
    loss also writes its model under ``weights/``, so the newest file there is the best so far.
    """
    spark, descent = batches.sparkSession, descent or Descent()
    ship_package(spark)
    known = stats_lookup(column_stats(batches, features))
    moments = [known.get(f, (0.0, 0.0)) for f in features]
    mean, std = np.array([m for m, _ in moments]), np.array([s + STD_EPS for _, s in moments])
    done = _last_epoch(spark, path)
    if done:
        scaled, velocity = (np.array(done[-1][k], float) for k in ("scaled", "velocity"))
    else:
        scaled = np.zeros((len(priors), len(features) + 1))
        scaled[:, -1] = np.log(np.maximum(priors, 1e-9))
        velocity = np.zeros_like(scaled)
    losses = [r["val_loss"] for r in done]
    for epoch in range(len(done), descent.epochs):
        if descent.patience is not None and _stale(losses) >= descent.patience:
            break
        loss = total = 0.0
        for step in range(descent.steps):
            sums = _gradient(batches.where(F.col("batch_id") == step), features, label, weight,
                             scaled, mean, std)
            loss, total = loss + sums[-2], total + sums[-1]
            if sums[-1]:
                velocity = descent.momentum * velocity - descent.rate * sums[:-2].reshape(
                    scaled.shape) / sums[-1]
                scaled = scaled + velocity
        model = _folded(features, scaled, mean, std)
        found = validation(model, val, label, val_weight)
        best = min((x for x in losses if x is not None), default=float("inf"))
        row = {**model.row(), "scaled": scaled.tolist(), "velocity": velocity.tolist(),
               "loss": float(loss / total) if total else None, **found}
        if found["val_loss"] is not None and found["val_loss"] < best:
            model.save(spark, f"{path}/weights/epoch={epoch:05d}")
        spark.createDataFrame([row], EPOCH_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/epochs/epoch={epoch:05d}")
        losses.append(found["val_loss"])
    return history(spark, path)


def _stale(losses: Sequence[float | None]) -> int:
    """Epochs since the lowest validation loss."""
    known = [float("inf") if x is None else x for x in losses]
    return len(known) - 1 - known.index(min(known)) if known else 0


def confusion_by_epoch(epochs: DataFrame) -> DataFrame:
    """``(epoch, pred, truth, weight)`` from a run's history."""
    return epochs.select("epoch", F.inline("confusion"))
