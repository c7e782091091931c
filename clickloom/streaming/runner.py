"""Starting streams and keeping what each micro-batch gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: A table, or what reads it. A table read by path keeps the files it had when it was
#: read, so streams that are to see rows added later get a function.
Lookup = DataFrame | Callable[[], DataFrame]


def now(table: Lookup) -> DataFrame:
    """The table as it is now."""
    return table() if callable(table) else table


def read_stream(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream, in the order they were written."""
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch={batch_id}"


def per_batch(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    mode: str = "append",
    transform: Callable[[DataFrame, int], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write what each micro-batch gives to a folder of its own.

    A batch that is run again after a failure replaces its folder, so nothing
    is written twice.
    """

    def write(rows: DataFrame, batch_id: int) -> None:
        result = transform(rows, batch_id) if transform else rows
        result.write.mode("overwrite").parquet(batch_folder(out, batch_id))

    writer = stream.writeStream.foreachBatch(write).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

@contextmanager
def state_partitions(
    spark: SparkSession, count: int | None = None, rows_at_once: int | None = None
) -> Iterator[None]:
    """Start streams with `count` state partitions, by default one per core, whose state
    lies in RocksDB, as timers and several states per key need.

    A stream keeps the number it was started with, and every micro-batch visits
    each partition, so the session's number for batch shuffles is often too high.
    `rows_at_once` is how many rows of a group come to Python together; its state comes
    with each such part, so groups with many small rows and much state want a high number.
    """
    wanted = {
        "spark.sql.shuffle.partitions": str(count or spark.sparkContext.defaultParallelism),
        "spark.sql.streaming.stateStore.providerClass": ROCKS_DB,
    }
    if rows_at_once:
        wanted["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(rows_at_once)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def finish(query: StreamingQuery) -> None:
    """Wait for the end; a failure of the stream is raised here."""
    query.awaitTermination()
