"""Complete small result grids (bins, matrix cells) with zeros, without a second scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_grid(aggregated: DataFrame, cell: str, n_cells: int, values: Sequence[str],
              group: Sequence[str] = ()) -> DataFrame:
    """Every cell ``0 .. n_cells-1`` of every group; absent ones get 0.

    ``aggregated`` already holds at most one row per cell and group, so the map built per group
    has at most ``n_cells`` entries whatever the size of the input.

    Cells outside the grid (NULL above all) are left out here, inside the aggregate, and not by a
    filter: a filter would be pushed below the first aggregation and evaluate the whole cell
    expression a second time for every row.
    """
    entry = F.when(F.col(cell).between(0, n_cells - 1),
                   F.struct(F.col(cell).cast("int"), F.struct(*values)))
    by_group = aggregated.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    cells = by_group.select(
        *group, "_cells", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias(cell))
    hit = F.try_element_at("_cells", F.col(cell))
    return cells.select(*group, cell, *[
        F.coalesce(hit[v], F.lit(0).cast(aggregated.schema[v].dataType)).alias(v)
        for v in values])
