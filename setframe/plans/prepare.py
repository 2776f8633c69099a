"""Preparation job: raw records in, labelled, normalised, weighted and chunked records out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from setframe.config import (BACKGROUND_PATTERN, REWEIGHT_BINS, REWEIGHT_RANGE, ROWS_PER_FILE,
                             ROWS_PER_FILE_BY_SOURCE)
from setframe.functions.labels import class_label, onehot
from setframe.operators import histograms, splitting, stats
from setframe.operators.selection import tidy_columns
from setframe.sources import scan, sinks


@dataclass(frozen=True)
class PrepareConfig:
    """``reweight`` and ``decay_mode`` name columns after tidying (no dots)."""

    decay_mode: str
    reweight: str
    drop_containing: Sequence[str] = ("TauCluster",)
    background_pattern: str = BACKGROUND_PATTERN
    label: str = "label"
    weight: str = "weight"
    n_bins: int = REWEIGHT_BINS
    value_range: tuple[float, float] = REWEIGHT_RANGE
    rows_per_file: int = ROWS_PER_FILE
    rows_by_source: Mapping[str, int] = field(default_factory=lambda: dict(ROWS_PER_FILE_BY_SOURCE))
    skip: Sequence[str] = field(default_factory=tuple)


def feature_columns(df: DataFrame, skip: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric scalar columns and numeric list columns, from the schema alone."""
    scalars, lists = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, NumericType):
            scalars.append(f.name)
        elif isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType):
            lists.append(f.name)
    return scalars, lists


def dataset_stats(df: DataFrame, skip: Sequence[str] = (), robust: bool = True) -> DataFrame:
    """``(feature, mean, stddev, n)`` of every numeric column, list columns flattened.

    All of them are read in one scan a pass (:func:`setframe.operators.stats.mixed_stats`).
    """
    scalars, lists = feature_columns(df, skip)
    return stats.mixed_stats(df, scalars, lists, robust)


def read_raw(spark: SparkSession, paths: str | Sequence[str], config: PrepareConfig) -> DataFrame:
    """Raw records with tidy names and ``is_fake`` taken from the file name.

    See :func:`setframe.sources.scan.input_name`.
    """
    raw = scan.with_file(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)))
    tidy = tidy_columns(raw, config.drop_containing)
    return scan.with_source_label(tidy, scan.input_name(F.col("file")), config.background_pattern)


def prepare(raw: DataFrame, known_stats: Mapping[str, tuple[float, float]],
            config: PrepareConfig) -> DataFrame:
    """Add ``<feature>_normed``, the label, its one-hot vector and the background weight."""
    scalars, lists = feature_columns(raw, config.skip)
    normed = stats.normalise_lists(stats.normalise_columns(raw, known_stats, scalars),
                                   known_stats, lists)
    labelled = normed.withColumn(config.label,
                                 class_label(F.col("is_fake"), F.col(config.decay_mode)))
    labelled = labelled.withColumn(f"{config.label}_onehot", onehot(F.col(config.label)))
    histogram = histograms.ratio_histogram(raw, config.reweight, F.col("is_fake"), config.n_bins,
                                           config.value_range)
    return histograms.apply_reweight(labelled, config.reweight, F.col("is_fake"), histogram,
                                     config.n_bins, config.value_range, config.weight)


def run(spark: SparkSession, paths: str | Sequence[str], out: str, config: PrepareConfig,
        stats_path: str | None = None) -> DataFrame:
    """The whole job. Stats are computed unless a stored table is given; output is split by file
    into train, validation and test and written in files of bounded size."""
    raw = read_raw(spark, paths, config)
    table = (dataset_stats(raw, config.skip) if stats_path is None
             else sinks.read_stats(spark, stats_path))
    prepared = prepare(raw, stats.stats_lookup(table), config)
    split = splitting.hash_split(prepared, "file")
    sinks.write_chunks(split, out, config.rows_per_file, ["split", "is_fake"],
                       scan.input_name(F.col("file")), config.rows_by_source)
    return spark.read.schema(split.schema).parquet(out)
