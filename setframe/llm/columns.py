"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setframe.session import ship_package


#: Rows of one Arrow batch at most: texts are long, and a batch is held by the JVM and by Python.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> None:
    """:func:`setframe.session.ship_package`, and batches of at most ``BATCH_ROWS`` rows in this
    session. Changes no result."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def texts(values: pa.Array) -> list[str]:
    """The strings of an Arrow column; NULL reads as empty."""
    return [v or "" for v in values.to_pylist()]


def struct_array(**columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns))


def fold(key: str | Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a NULL key is fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0))


def inner(name: str) -> str:
    """A column name that an input table is not expected to have."""
    return f"__sf_{name}"


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str,
                    train: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` rows ``(t, y)`` of either class among the training rows, in the order of
    a digest of the key; the labels are chosen first, so that the documents are only scanned."""
    known = (labels.where(train).where(F.col(key).isNotNull())
             .groupBy(F.col(key).alias("__sf_key")).agg(F.max(label).alias("y"))
             .where("y is not null"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("y") == value).orderBy(F.xxhash64("__sf_key"), "__sf_key")
        part = part.limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    return (docs.select(F.col(key).alias("__sf_key"), F.col(text).alias("t"))
            .join(F.broadcast(chosen), "__sf_key").select("t", F.col("y").cast("int").alias("y")))
