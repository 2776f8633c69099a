"""Bounded-size incremental reads with Structured Streaming.

Files are taken a few at a time (``maxFilesPerTrigger``) until none are left (``availableNow``).
Checkpoints and outputs live in the folder named by ``spark.checkpoint.dir``, so a lost executor
costs no committed micro-batch. A restarted driver resumes where it is given the same ``path`` and
``checkpoint`` again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setframe.session import scratch_path

SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
SUCCESS_MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def stream_files(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                 files_per_trigger: int = 4) -> DataFrame:
    reader = (spark.readStream.format("parquet").schema(schema)
              .option("maxFilesPerTrigger", files_per_trigger))
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def write_until_done(stream: DataFrame, name: str, path: str | None = None,
                     checkpoint: str | None = None,
                     partition_by: Sequence[str] = ()) -> str:
    """Append a row-wise stream to Parquet (exactly once) and wait; returns the output path."""
    spark = stream.sparkSession
    out = path or scratch_path(spark, f"{name}-out")
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-state"))
              .trigger(availableNow=True))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(out).awaitTermination()
    return out


def keep_latest_totals(stream: DataFrame, name: str, path: str | None = None,
                       checkpoint: str | None = None, partitions: int | None = None) -> str:
    """Run an aggregating stream to the end; every trigger stores its totals beside the earlier ones.

    A micro-batch writes a folder of its own (``batch_id=<n>``), so a crash leaves the last complete
    totals in place and a replayed batch writes the same folder again. Read the newest with
    :func:`latest_totals`. With ``path`` and ``checkpoint`` given, a restart goes on where it stopped.

    The state is spread over ``partitions``, or over the session's shuffle partitions; each is a task
    and a state file at every trigger, so for a few groups give a few. A checkpoint keeps the number it began with.
    """
    spark = stream.sparkSession
    out = path or scratch_path(spark, f"{name}-out")

    def replace(totals: DataFrame, batch_id: int) -> None:
        # The mark of success is one more file a trigger, and nothing reads it.
        (totals.write.mode("overwrite").option(SUCCESS_MARK, "false")
         .parquet(f"{out}/batch_id={batch_id}"))

    writer = (stream.writeStream.outputMode("complete").foreachBatch(replace)
              .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-state"))
              .trigger(availableNow=True))
    usual = spark.conf.get(SHUFFLE_PARTITIONS)
    if partitions is not None:
        spark.conf.set(SHUFFLE_PARTITIONS, partitions)
    try:
        query = writer.start()  # runs in a copy of the session made here
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, usual)
    query.awaitTermination()
    return out


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest micro-batch that was stored completely."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("batch_id")).scalar()
    return stored.where(F.col("batch_id") == newest).drop("batch_id")


def running_stats(stream: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Counts, means and population deviations per group, kept up to date as files arrive."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_stddev")]
    return stream.groupBy(group).agg(*aggregates)


def process_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str,
                   partition_by: Sequence[str] = (), path: str | None = None,
                   checkpoint: str | None = None) -> DataFrame:
    """Apply a row-wise transformation while streaming, then return the written table.

    Give ``path`` and ``checkpoint`` to go on after a restart; without them a run starts afresh.
    """
    transformed = transform(stream)
    out = write_until_done(transformed, name, path, checkpoint, partition_by)
    return stream.sparkSession.read.schema(transformed.schema).parquet(out)
