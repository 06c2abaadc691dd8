"""Batch and file-stream readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_stream(spark: SparkSession, path: str, schema: StructType | None = None,
                max_files_per_trigger: int | None = None,
                max_bytes_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream; the two limits bound what one micro-batch takes in.

    ``path`` is a folder or a single file.

    Files are taken in order of their modification time. With a watermark delay of
    0 seconds a limit is only safe where that order follows event time; without a
    limit everything present is one micro-batch and no row can be late.
    """
    if schema is None:
        schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or files.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    # a stream's plain path has to be a folder: a single file is named by a pattern that fits it alone
    folder, slash, name = path.rpartition("/")
    *literal, last = [f"\\{c}" if c in "*?{}[]\\" else c for c in name]
    return reader.parquet(f"{folder}{slash}{''.join(literal)}{last if len(last) > 1 else f'[{last}]'}")
