"""Helpers the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.storage import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a fresh folder under `spark.checkpoint.dir` and read back.

    This cuts the lineage without tying any row to the executor that made it.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    give_back()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Rows kept by the executors between two jobs; a lost part is made again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker and is shared by its tasks.

    A worker keeps one such dict: that of another operator is let go.
    """
    holder = sys.modules.setdefault(
        "clickloom_worker_cache", types.ModuleType("clickloom_worker_cache")
    )
    if getattr(holder, "name", None) != name:
        holder.name, holder.kept = name, {}
        give_back()
    return holder.kept


def give_back() -> None:
    """Let memory that is no longer used go back to the system.

    A Python worker lives on after its task, beside the executor's own memory, as the
    driver's Python does beside the driver's.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def column_batch(schema: pa.Schema, columns: Sequence[Iterable]) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def small_batches(
    batches: Iterator[pa.RecordBatch], rows: int, size: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows, so that memory follows the rows in work.

    With `size`, also to at most so many bytes, or one row. After the last one, memory
    that is no longer used is given back.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(at, rows), size)
    batch = None
    give_back()


def _halved(batch: pa.RecordBatch, size: int | None) -> Iterator[pa.RecordBatch]:
    if size is None or batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halved(batch.slice(0, half), size)
    yield from _halved(batch.slice(half), size)


def few_rows(spark: SparkSession, rows: Iterable[tuple], schema: pa.Schema) -> DataFrame:
    """Rows made on the driver, given to Spark as Arrow.

    Of a list Spark makes an RDD, read by a second kind of Python workers, which then live on
    beside those of the operators.
    """
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return spark.createDataFrame(pa.Table.from_batches([column_batch(schema, columns)], schema))


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))
