"""Permutation feature importance in one job.

The obvious plan is one full pass over the data per feature. Here every row carries the inputs of
one donor row (one shuffle, see ``splitting.permute_columns``); a task then scores the baseline and
every variant of its batch and emits one partial sum per feature. What reaches the final
aggregation is ``batches x features`` tiny rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setframe.config import SPLIT_SEED
from setframe.operators.scoring import PROBABILITY_FLOOR, DeepSet, to_matrix
from setframe.operators.splitting import permute_columns
from setframe.session import ship_package

BASELINE = ""
DONOR = "_donor"
PARTIAL_SCHEMA = "feature string, loss double, correct double, n bigint"


def variant_sums(df: DataFrame, model: DeepSet, features: dict[str, Sequence[str]], label: str,
                 weight: str | None = None) -> DataFrame:
    """Partial loss sums per feature, one row per (batch, feature).

    ``df`` has each input column and its ``_donor`` twin. ``features`` names the features of each
    input column in tensor order. Only the permuted branch is embedded again for a variant. Rows
    without a class (NULL or no index of the scores) are left out.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model, features))
    inputs = [b.column for b in model.branches]
    needed = [*inputs, *[f"{c}{DONOR}" for c in inputs], label, *([weight] if weight else [])]

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, names = shared.value
        n_classes = len(net.head[-1].bias)
        for batch in batches:
            # Rows without a class have no loss: they are in no sum and in no count.
            known = batch.column(label)
            batch = batch.filter(pc.and_(pc.greater_equal(known, 0), pc.less(known, n_classes)))
            if batch.num_rows == 0:
                continue
            truth = batch.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.arange(len(truth))
            w = np.ones(len(truth)) if weight is None else \
                batch.column(weight).to_numpy(zero_copy_only=False)
            own = {b.column: to_matrix(batch.column(b.column), b.n_features * b.max_objects)
                   for b in net.branches}
            embedded = [b.embed(own[b.column]) for b in net.branches]
            out: dict[str, list] = {"feature": [], "loss": [], "correct": [], "n": []}

            def add(name: str, scores: np.ndarray) -> None:
                p = np.clip(scores[rows, truth], PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
                out["feature"].append(name)
                out["loss"].append(float((w * -np.log(p)).sum()))
                out["correct"].append(float((scores.argmax(axis=1) == truth).sum()))
                out["n"].append(len(truth))

            add(BASELINE, net.merge(embedded))
            for i, b in enumerate(net.branches):
                donor = to_matrix(batch.column(f"{b.column}{DONOR}"),
                                  b.n_features * b.max_objects)
                for j, name in enumerate(names[b.column]):
                    plane = slice(j * b.max_objects, (j + 1) * b.max_objects)
                    changed = own[b.column].copy()
                    changed[:, plane] = donor[:, plane]
                    variant = [*embedded[:i], b.embed(changed), *embedded[i + 1:]]
                    add(name, net.merge(variant))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("feature", pa.string()), ("loss", pa.float64()),
                 ("correct", pa.float64()), ("n", pa.int64())]))

    return df.select(*needed).mapInArrow(partial_sums, PARTIAL_SCHEMA)


def permutation_importance(df: DataFrame, model: DeepSet, features: dict[str, Sequence[str]],
                           unit: str, label: str, weight: str | None = None,
                           seed: int = SPLIT_SEED) -> DataFrame:
    """``(feature, loss_delta, accuracy_delta, importance_rank)``, most important first."""
    inputs = [b.column for b in model.branches]
    kept = df.select(unit, label, *([weight] if weight else []), *inputs)
    donated = permute_columns(kept, inputs, unit, seed, suffix=DONOR)
    totals = variant_sums(donated, model, features, label, weight).groupBy("feature").agg(
        (F.sum("loss") / F.sum("n")).alias("loss"),
        (F.sum("correct") / F.sum("n")).alias("accuracy"))
    # From here on there is one row per feature plus the baseline.
    everything = Window.partitionBy()
    baseline = F.col("feature") == F.lit(BASELINE)
    deltas = totals.select(
        "feature",
        (F.col("loss") - F.max(F.when(baseline, F.col("loss"))).over(everything))
        .alias("loss_delta"),
        (F.max(F.when(baseline, F.col("accuracy"))).over(everything) - F.col("accuracy"))
        .alias("accuracy_delta")).where(~baseline)
    return deltas.withColumn("importance_rank", F.rank().over(
        Window.orderBy(F.desc("loss_delta")))).orderBy("importance_rank", "feature")
