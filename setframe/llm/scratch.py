"""Written intermediates that can be removed once nothing reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from setframe.session import scratch_path


class Stored:
    """A table in the shared scratch folder (:func:`setframe.session.materialise`) with its path."""

    def __init__(self, df: DataFrame, name: str) -> None:
        spark = df.sparkSession
        self._spark, self.path = spark, scratch_path(spark, name)
        df.write.parquet(self.path)
        self.rows = spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        """Delete the table through Hadoop's file system; what was derived from it must be written."""
        context = self._spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
