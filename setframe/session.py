"""Session-level helpers: shared scratch folder and size rules for broadcasts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast only when its row count is bounded by construction at or below this.
MAX_BROADCAST_ROWS = 1_000_000

# Session settings that suit the workload; none changes a result.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Object lists are capped before they are collected, so hashing many keys at once is safe.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
    # Building wide projections costs a stack capture per expression otherwise.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
_shipped: set[str] = set()
_own_scratch: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, wherever the driver was started.

    What ``--py-files`` does, once per application; called before any Arrow function.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="setframe-")) / "setframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for a written table or a stream checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``, or else the context's
    checkpoint folder. Only in a local session without either is one of our own made, once per
    process; anywhere else the executors could not see it, and an error says so.
    """
    global _own_scratch
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_scratch is None:
            _own_scratch = tempfile.mkdtemp(prefix="setframe-")
        base = _own_scratch
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks a core while this lasts.

    Spark makes a task for each of up to 10,000 folders, and a task costs more than listing a folder. Changes no result.
    """
    usual = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, min(int(usual), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, usual)


def broadcast_bounded(small: DataFrame, row_bound: int | None) -> DataFrame:
    """Hint a broadcast only when ``row_bound`` proves that the table stays small.

    Without a bound the join strategy is left to the optimiser.
    """
    if row_bound is not None and row_bound <= MAX_BROADCAST_ROWS:
        return F.broadcast(small)
    return small


def broadcast_if_small(small: DataFrame) -> DataFrame:
    """Count a table (meant for stored ones, where footers answer) and hint a broadcast if it is
    within the limit; beyond it the join is left to the optimiser."""
    return broadcast_bounded(small, small.count())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    For an intermediate that several later steps use: its input is read once, whatever the
    optimiser does with the copies, and a lost executor costs a re-read instead of a re-run.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
