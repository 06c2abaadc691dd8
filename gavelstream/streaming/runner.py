"""Running a streaming query over what is there, or on and on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gavelstream.session import scratch_dir


@dataclass(frozen=True)
class PerBatch:
    """A stream of finished rows, and what is to be made of each micro-batch of them."""

    stream: DataFrame
    finish: Callable[[DataFrame], DataFrame]
    schema_ddl: str

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.schema_ddl)

    @property
    def sparkSession(self):
        return self.stream.sparkSession

    def write(self, path: str | None) -> Callable[[DataFrame, int], None]:
        """A batch that is done again, after a failure, replaces its own rows."""
        def one(batch: DataFrame, number: int) -> None:
            held = batch.persist(StorageLevel.DISK_ONLY)
            writer = self.finish(held).write.mode("overwrite")
            if path is None:
                writer.format("noop").save()
            else:
                writer.parquet(f"{path}/batch={number}")
            held.unpersist()
        return one


def start(df: DataFrame | PerBatch, name: str, path: str | None = None, checkpoint: str | None = None,
          every: str | None = "1 second", empty_batches: bool = True) -> StreamingQuery:
    """Start ``df`` in append mode; without ``path`` the rows are computed and discarded.

    ``every=None`` takes in all input present now and then stops; otherwise the query has no end and
    needs a ``checkpoint``. Restarting with the same one goes on where the last run, or a lost driver,
    left off. Without ``empty_batches`` there are only micro-batches with input: state that goes by the clock would
    else bring up one after another, and a run over what is present would not stop.
    """
    if every is not None and checkpoint is None:
        raise ValueError("a query without an end needs a checkpoint folder, or a lost driver loses its state")
    stream = df.stream if isinstance(df, PerBatch) else df
    writer = (stream.writeStream.outputMode("append").queryName(name)
              .option("checkpointLocation", checkpoint or scratch_dir(stream.sparkSession, f"{name}-checkpoint")))
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    # a query keeps the settings that it started with
    conf.set(setting, str(empty_batches and before == "true").lower())
    try:
        if isinstance(df, PerBatch):
            return writer.foreachBatch(df.write(path)).start()
        if path is None:
            return writer.format("noop").start()
        return writer.format("parquet").start(path)
    finally:
        conf.set(setting, before)


def run_to_table(df: DataFrame | PerBatch, name: str, path: str | None = None,
                 checkpoint: str | None = None, empty_batches: bool = True) -> DataFrame:
    """Process all input present now into Parquet and read the result back as a table."""
    path = path or scratch_dir(df.sparkSession, f"{name}-output")
    start(df, name, path, checkpoint, every=None, empty_batches=empty_batches).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.schema.names)


def run_discarding(df: DataFrame | PerBatch, name: str, empty_batches: bool = True) -> list:
    """Process all input present now into nothing; returns the progress of each batch."""
    query = start(df, name, every=None, empty_batches=empty_batches)
    query.awaitTermination()
    return query.recentProgress
