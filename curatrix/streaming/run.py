"""Running a stream to the end of what there is, and sinks that survive a restart."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources import scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that processors of their own need, for the streams started within."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def stream_of(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A Parquet table, a folder or one file, as a stream, at most so many files in a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    whole = f"{path[:-1]}[{path[-1]}]"  # as a pattern, since a plain path must be a folder
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(whole)


def settled(stream: DataFrame, name: str) -> DataFrame:
    """What the stream puts out for all that its sources hold now, written to the shared folder and read again."""
    spark = stream.sparkSession
    path = scratch.folder(spark, name)
    with state_store(spark):
        started = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
        started.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(path)
    scratch.remove(spark, f"{path}-state")
    return out


class BatchFolders:
    """A foreachBatch sink that writes each batch into a folder of its own, named by the batch's number.

    A batch that is run again, because the query died after the write and before
    the commit, replaces its folder, so each row is there once. The rows of a batch
    must be the same when it is run again, as those of files and of a checkpoint are.
    """

    def __init__(self, path: str, after: Callable[[int], None] | None = None):
        self.path, self.after = path, after

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        if self.after:
            self.after(number)

    def table(self, spark: SparkSession, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/batch=*")


def poll(stream: DataFrame, sink: BatchFolders, checkpoint: str, seconds: int | None = None):
    """Starts a query that looks for new rows every so many seconds; without a period, once for all that is there.

    Stopped and started again with the same checkpoint, it goes on where it was.
    """
    trigger = {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**trigger).start()
