"""Tables in ranges of ids, of which a change rewrites only the ranges it touches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickloom.plans.numbering import ID_RANGE


LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listers(spark: SparkSession) -> Iterator[None]:
    """Have many folders listed by a task per core. By default each is a task of its own,
    whose report to the driver is much larger than what it has found."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTERS, before)


@dataclass(frozen=True)
class Snapshot:
    """A table with a unique integer `id`, kept under `folder` in ranges of `width` ids.

    Each version is a folder of the ranges that it wrote whole, and a manifest that
    names them, written last. Of a range the highest version counts, so a version that
    was not finished is not seen, and one that is run again replaces its own files. Ids
    are given in ascending order, so what changes soon after it came, as unlocked clicks
    do, lies in the last few ranges. Rows without an id are not kept.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    width: int = ID_RANGE

    def range_of(self, id_column: Column) -> Column:
        return F.floor(id_column / F.lit(self.width)).cast("long")

    def write(self, rows: DataFrame, version: int) -> None:
        """Store `rows`, which are all rows of each range that they have a row of.

        A range has at most `width` rows, since ids are unique, and is written by one task.
        """
        data = f"{self.folder}/data/version={version}"
        placed = rows.filter("id IS NOT NULL").withColumn("range", self.range_of(F.col("id")))
        placed.repartition("range").write.mode("overwrite").partitionBy("range").parquet(data)
        layout = StructType([*self.schema.fields]).add("range", "long")
        with few_listers(self.spark):
            written = self.spark.read.schema(layout).parquet(data).select("range").distinct()
        named = written.withColumn("version", F.lit(version).cast("long"))
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/of={version}")

    def ranges(self, before: int | None = None) -> DataFrame:
        """(range, version) of what counts, one row per range of ids in use."""
        manifest = self.spark.read.schema("range long, version long").parquet(
            f"{self.folder}/manifest"
        )
        if before is not None:
            manifest = manifest.filter(F.col("version") < before)
        return manifest.groupBy("range").agg(F.max("version").alias("version"))

    def read(self, ids: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """The table, or the ranges that hold some id of the one column of `ids`.

        `before` leaves out that version and later ones, as a version that may run again
        must. Only the folders of the ranges wanted are listed; the driver gets one row for
        each of them, one per `width` ids at most.
        """
        wanted = self.ranges(before)
        if ids is not None:
            tried = ids.select(self.range_of(F.col(ids.columns[0])).alias("range")).dropna()
            wanted = wanted.join(tried.distinct(), "range", "left_semi")
        folders = [
            f"{self.folder}/data/version={r['version']}/range={r['range']}" for r in wanted.collect()
        ]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        with few_listers(self.spark):
            return self.spark.read.schema(self.schema).parquet(*sorted(folders))
