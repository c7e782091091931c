"""Where derived tables and stream state may be written."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_STAGED: dict[tuple[str, str], tuple[str, StructType]] = {}
_LOCAL: list[str] = []


def work_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in `spark.checkpoint.dir`.

    Only a session that runs on one machine may use a folder of that machine
    instead; elsewhere there is none (None).
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        return _local_folder()
    return None


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="clickloom-"))
    return _LOCAL[0]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder."""
    base = work_folder(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base}/clickloom/{name}-{uuid.uuid4().hex}"


def staged(
    spark: SparkSession, key: str, name: str, build: Callable[[], DataFrame]
) -> tuple[str, StructType]:
    """Folder and layout of a derived table, written once per session."""
    slot = (spark.sparkContext.applicationId, f"{key}/{name}")
    if slot not in _STAGED:
        path = new_folder(spark, name)
        built = build()
        built.write.parquet(path)
        _STAGED[slot] = path, built.schema
    return _STAGED[slot]


def stage(
    spark: SparkSession, key: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A derived table, read back from where it is staged.

    Readers then start from a stored table, as they would in the service, with a
    known size and a short lineage. Without a work folder the table stays a plan.
    """
    if work_folder(spark) is None:
        return build()
    path, schema = staged(spark, key, name, build)
    return spark.read.schema(schema).parquet(path)
