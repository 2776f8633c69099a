"""Ranking job: permutation importance of every configured feature, written as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setframe.config import SPLIT_SEED, DatasetConfig
from setframe.operators.importance import permutation_importance
from setframe.operators.scoring import Scorer
from setframe.operators.selection import apply_class_cuts
from setframe.sources import sinks


def rank(rows: DataFrame, model: Scorer, config: DatasetConfig, unit: str,
         background: str = "is_fake", seed: int = SPLIT_SEED) -> DataFrame:
    """``unit`` is the record key that fixes the permutation."""
    kept = rows if config.cuts is None else apply_class_cuts(rows, config.cuts,
                                                             F.col(background))
    inputs, network, features = model.ranking(kept, config, [unit])
    return permutation_importance(inputs, network, features, unit, config.label, config.weight, seed)


def run(rows: DataFrame, model: Scorer, config: DatasetConfig, unit: str, out: str) -> DataFrame:
    table = rank(rows, model, config, unit)
    sinks.write_importance(table, out)
    return rows.sparkSession.read.csv(out, header=True, schema=table.schema)
