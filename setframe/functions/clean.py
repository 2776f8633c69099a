"""Value cleaning and normalisation."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from setframe.config import NORM_EPSILON, OUTLIER_LIMIT, PAD_VALUE

MAX_DOUBLE = sys.float_info.max


def clean_nonfinite(x: Column) -> Column:
    """NaN becomes 0, the infinities become the largest finite values. NULL stays NULL."""
    return (F.when(F.isnan(x), F.lit(0.0))
            .when(x == F.lit(float("inf")), F.lit(MAX_DOUBLE))
            .when(x == F.lit(float("-inf")), F.lit(-MAX_DOUBLE))
            .otherwise(x))


def zero_outliers(x: Column, limit: float = OUTLIER_LIMIT) -> Column:
    """Keep ``|x| < limit``, everything else (pads, NaN, infinities) becomes 0."""
    return F.when(F.abs(x) < F.lit(limit), x).otherwise(F.lit(0.0))


def normalise(x: Column, mean: Column | float, stddev: Column | float) -> Column:
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    stddev = stddev if isinstance(stddev, Column) else F.lit(float(stddev))
    return (x - mean) / (stddev + F.lit(NORM_EPSILON))


def normalise_array(arr: Column, mean: Column | float, stddev: Column | float) -> Column:
    return F.transform(arr, lambda x: normalise(x.cast("double"), mean, stddev))


def drop_pads(arr: Column, pad: float = PAD_VALUE) -> Column:
    return F.filter(arr, lambda x: x != F.lit(pad))


def is_nan(x: Column) -> Column:
    """True for NaN and for NULL: both are unusable as a model input."""
    return F.isnan(x) | x.isNull()
