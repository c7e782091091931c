"""Reading and appending the stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clickloom.plans.numbering import with_next_ids


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table with its declared columns; filters and columns reach the scan."""
    return spark.read.schema(schema).parquet(path)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    schema: StructType,
    id_bounds: tuple[int, int],
    partitions: int,
    **options,
) -> DataFrame:
    """The same table from a live database, read in parallel ranges of `id`."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn="id",
        lowerBound=id_bounds[0],
        upperBound=id_bounds[1],
        numPartitions=partitions,
        **options,
    )
    loaded = reader.load()
    return loaded.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_rows(current: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """`current` with `new` added under the ids that follow its highest one."""
    added = with_next_ids(current, new, order).select(
        *[F.col(c) if c in new.columns + ["id"] else F.lit(None).alias(c) for c in current.columns]
    )
    return current.unionByName(added)


def write_clicks(clicks: DataFrame, path: str, replace: bool = False) -> None:
    """Store clicks, one folder per day, so that reports over a time range read only it.

    They are added to what is there; with `replace` they take the place of what is
    there of their days, and other days stay, so a load that runs again doubles nothing.
    Clicks without a time go to a folder of their own.
    """
    writer = clicks.withColumn("date", F.to_date("timestamp")).write.partitionBy("date")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def read_days(
    spark: SparkSession, path: str, schema: StructType, start: datetime, end: datetime
) -> DataFrame:
    """Stored clicks with `start <= timestamp < end`; folders of other days are not read."""
    stored = spark.read.schema(StructType([*schema.fields]).add("date", "date")).parquet(path)
    return stored.filter(
        F.col("date").between(F.lit(start.date()), F.lit(end.date()))
        & (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("timestamp") < F.lit(end).cast("timestamp_ntz"))
    ).drop("date")
