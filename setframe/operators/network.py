"""Networks trained elsewhere: batch normalisation folded into dense layers, and weights as a table.

A network is stored as one row for each layer, so any tool that can write a table can hand its weights
over; the newest such table under a folder is found by its file's time.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from setframe.operators.scoring import Branch, DeepSet, Dense
from setframe.sources.scan import latest_path

LAYER_SCHEMA = ("input string, input_order int, n_features int, max_objects int, by_feature boolean, "
                "part string, layer int, weight array<array<double>>, bias array<double>, "
                "activation string, mean array<double>, variance array<double>, "
                "gamma array<double>, beta array<double>, epsilon double")
PARTS = ("per_object", "dense")
HEAD, NORM = "head", "norm"


@dataclass(frozen=True)
class Normalisation:
    """Batch normalisation as it is applied after training: by moving mean and variance."""

    mean: np.ndarray
    variance: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray
    epsilon: float = 1e-3

    @property
    def scale(self) -> np.ndarray:
        return self.gamma / np.sqrt(self.variance + self.epsilon)

    @property
    def shift(self) -> np.ndarray:
        return self.beta - self.mean * self.scale


def folded(model: DeepSet, norms: Mapping[str, Normalisation]) -> DeepSet:
    """The network in which the outputs of the named inputs are normalised before they are merged.

    Scaling and shifting before a dense layer is that layer with other weights, so scoring costs
    nothing more: the first head layer takes them in.
    """
    first = model.head[0]
    scales, shifts = [], []
    for b in model.branches:
        width = _width(b)
        norm = norms.get(b.column)
        scales.append(np.ones(width) if norm is None else norm.scale)
        shifts.append(np.zeros(width) if norm is None else norm.shift)
    scale, shift = np.concatenate(scales), np.concatenate(shifts)
    merged = replace(first, weight=first.weight * scale[:, None], bias=first.bias + shift @ first.weight)
    return replace(model, head=(merged, *model.head[1:]))


def _width(branch: Branch) -> int:
    layers = [*branch.per_object, *branch.dense]
    return len(layers[-1].bias) if layers else branch.n_features


def layer_rows(model: DeepSet, norms: Mapping[str, Normalisation] | None = None) -> list[tuple]:
    """A network as rows of ``LAYER_SCHEMA``; normalisations are kept as they are."""
    rows = []
    for order, b in enumerate(model.branches):
        shape = (b.column, order, b.n_features, b.max_objects, b.by_feature)
        rows.append((*shape, "input", 0, *[None] * 8))
        for part in PARTS:
            rows += [(*shape, part, i, d.weight.tolist(), d.bias.tolist(), d.activation, *[None] * 5)
                     for i, d in enumerate(getattr(b, part))]
        norm = (norms or {}).get(b.column)
        if norm is not None:
            rows.append((*shape, NORM, 0, None, None, None, norm.mean.tolist(), norm.variance.tolist(),
                         norm.gamma.tolist(), norm.beta.tolist(), float(norm.epsilon)))
    rows += [(None, None, None, None, None, HEAD, i, d.weight.tolist(), d.bias.tolist(), d.activation,
              *[None] * 5) for i, d in enumerate(model.head)]
    return rows


def save(spark: SparkSession, model: DeepSet, path: str,
         norms: Mapping[str, Normalisation] | None = None) -> None:
    """One file: it is there completely or not at all."""
    table = spark.createDataFrame(layer_rows(model, norms), LAYER_SCHEMA)
    table.coalesce(1).write.mode("overwrite").parquet(path)


def from_table(table: DataFrame) -> DeepSet:
    """The network of a table of layers (some tens of rows), normalisations folded in."""
    rows = table.orderBy(F.col("input_order").asc_nulls_last(), "part", "layer").collect()
    inputs = [r for r in rows if r["part"] == "input"]
    branches, norms = [], {}
    for r in inputs:
        own = [x for x in rows if x["input"] == r["input"]]
        parts = {part: tuple(_dense(x) for x in own if x["part"] == part) for part in PARTS}
        branches.append(Branch(r["input"], r["n_features"], r["max_objects"], **parts,
                               by_feature=bool(r["by_feature"])))
        for x in own:
            if x["part"] == NORM:
                norms[r["input"]] = Normalisation(*(np.array(x[c], float) for c in (
                    "mean", "variance", "gamma", "beta")), x["epsilon"])
    return folded(DeepSet(tuple(branches), tuple(_dense(r) for r in rows if r["part"] == HEAD)), norms)


def _dense(row: Row) -> Dense:
    return Dense(np.array(row["weight"], float), np.array(row["bias"], float), row["activation"])


def load(spark: SparkSession, path: str) -> DeepSet:
    return from_table(spark.read.schema(LAYER_SCHEMA).parquet(path))


def load_newest(spark: SparkSession, pattern: str) -> DeepSet:
    """The network in the most recently written file that matches a glob."""
    return load(spark, latest_path(spark, pattern))
