"""From object rows and record rows to fixed-shape model inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setframe.config import DatasetConfig
from setframe.functions.ragged import flat_tensor, list_tensor, scalar_vector


def leading_objects(objects: DataFrame, key: Sequence[str], order: Sequence[str],
                    cap: int, name: str = "idx") -> DataFrame:
    """The first ``cap`` objects of each record. A ``row_number() <= cap`` filter is limited per
    map task before the shuffle, so a record owning a large part of the table stays cheap."""
    window = Window.partitionBy(*key).orderBy(*order)
    return objects.withColumn(name, F.row_number().over(window)).where(F.col(name) <= cap)


def collect_objects(objects: DataFrame, key: str, order: Sequence[str], fields: Sequence[str],
                    cap: int, name: str = "objects") -> DataFrame:
    """One ``array<struct>`` of at most ``cap`` objects per record, in order; one shuffle."""
    first = leading_objects(objects, [key], order, cap)
    return first.groupBy(key).agg(_in_order(F.struct("idx", *fields)).alias(name))


def collect_collections(objects: DataFrame, key: str, order: Sequence[str],
                        fields: Sequence[str], kind: str, caps: Mapping[str, int],
                        overall: tuple[str, int] | None = None) -> DataFrame:
    """One capped list per kind of object and record, and optionally one over all kinds.

    Objects are first limited per (record, kind). The first ``n`` objects of all kinds are among
    the first ``n`` of their own kinds, so the overall list needs no ranking of its own and no
    second copy of the objects.
    """
    name, n = overall or ("", 0)
    first = leading_objects(objects, [key, kind], order, max(*caps.values(), n))
    lists = [_in_order(F.when((F.col(kind) == F.lit(k)) & (F.col("idx") <= F.lit(cap)),
                              F.struct("idx", *fields))).alias(k) for k, cap in caps.items()]
    if overall is not None:
        candidates = F.when(F.col("idx") <= F.lit(n), F.struct(
            *order, *[f for f in fields if f not in order]))
        lists.append(F.slice(_in_order(candidates), 1, n).alias(name))
    return first.groupBy(key).agg(*lists)


def _in_order(item: Column) -> Column:
    return F.array_sort(F.collect_list(item))


def model_inputs(records: DataFrame, collections: Mapping[str, tuple[Sequence[str], int]],
                 scalars: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One projection: a flat tensor per collection, the scalar vector, and the kept columns.

    ``records`` has an ``array<struct>`` column per collection (NULL when there is no object).
    """
    tensors = [flat_tensor(c, fields, cap).alias(c)
               for c, (fields, cap) in collections.items()]
    return records.select(*keep, *tensors,
                          scalar_vector(scalars).alias("scalars"))


def dataset_inputs(df: DataFrame, config: DatasetConfig, keep: Sequence[str] = ()) -> DataFrame:
    """Inputs for the stored layout, where every feature is a column of its own."""
    inputs = []
    for c in config.collections:
        built = list_tensor(c.features, c.max_objects) if c.ragged else scalar_vector(c.features)
        inputs.append(built.alias(c.name))
    kept = list(dict.fromkeys([*keep, config.label, config.weight]))
    return df.select(*inputs, *kept)


def pooled_features(rows: DataFrame, config: DatasetConfig, keep: Sequence[str]
                    ) -> tuple[DataFrame, list[str]]:
    """One number per feature: list features are summed over their first ``max_objects``."""
    columns = []
    for c in config.collections:
        for f in c.features:
            if c.ragged:
                kept = [f"coalesce(nanvl(cast(get(`{f}`, {i}) as double), 0D), 0D)"
                        for i in range(c.max_objects)]
                columns.append(F.expr(" + ".join(kept)).alias(f))
            else:
                columns.append(F.expr(f"coalesce(nanvl(cast(`{f}` as double), 0D), 0D)").alias(f))
    names = [f for c in config.collections for f in c.features]
    return rows.select(*keep, *columns), names
