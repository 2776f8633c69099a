"""Class labels and score vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from setframe.config import BACKGROUND_PATTERN, N_CLASSES


def is_background(source: Column, pattern: str = BACKGROUND_PATTERN) -> Column:
    """Background rows are told apart by their source (or file) name."""
    return source.contains(pattern)


def class_label(background: Column, decay_mode: Column, n_classes: int = N_CLASSES) -> Column:
    """0 for background, ``decay_mode + 1`` for signal, NULL for a decay mode outside the classes."""
    valid = decay_mode.between(0, n_classes - 2)
    return F.when(background, F.lit(0)).when(valid, decay_mode + F.lit(1)).cast("int")


def onehot(label: Column, n_classes: int = N_CLASSES) -> Column:
    """NULL label gives a NULL vector."""
    vector = F.array(*[(label == F.lit(i)).cast("int") for i in range(n_classes)])
    return F.when(label.isNotNull(), vector)


def argmax(vector: Column) -> Column:
    """0-based index of the largest element; the first one wins a tie."""
    return (F.array_position(vector, F.array_max(vector)) - F.lit(1)).cast("int")


def drop_background(vector: Column, n_classes: int = N_CLASSES) -> Column:
    return F.slice(vector, 2, n_classes - 1)


def signal_score(scores: Column) -> Column:
    return F.lit(1.0) - F.get(scores, F.lit(0))


def score_columns(scores: Column, names: list[str]) -> list[Column]:
    return [F.get(scores, F.lit(i)).alias(n) for i, n in enumerate(names)]


def truth_probability(scores: Column, label: Column) -> Column:
    return F.get(scores, label)
