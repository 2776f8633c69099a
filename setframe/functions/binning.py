"""Equal-width bins computed arithmetically, so bin lookups are equi-joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_bin(x: Column, lo: Column | float, hi: Column | float, n_bins: int,
                    last_edge: bool = False) -> Column:
    """0-based bin of ``[lo, hi)``, NULL outside. ``last_edge`` puts ``x == hi`` into the last bin."""
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    raw = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(float(n_bins))).cast("int")
    capped = F.least(raw, F.lit(n_bins - 1))
    if last_edge:
        inside = (x >= lo) & (x <= hi)
        return F.when(inside, F.coalesce(capped, F.lit(0)))
    return F.when((x >= lo) & (x < hi), capped)


def bin_edges(bin_: Column, lo: Column | float, hi: Column | float,
              n_bins: int) -> tuple[Column, Column]:
    lo = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi = hi if isinstance(hi, Column) else F.lit(float(hi))
    width = (hi - lo) / F.lit(float(n_bins))
    return lo + bin_ * width, lo + (bin_ + F.lit(1)) * width
