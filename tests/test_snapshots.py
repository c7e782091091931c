"""Stored clicks in ranges of ids and in days."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from clickloom.operators.clicks import apply_unlocks, unlock_outcomes
from clickloom.registry import QUERIES
from clickloom.sources import tables
from clickloom.sources.snapshots import Snapshot
from clickloom.streaming import clicks as live_clicks
from tests.test_streaming import SF_DIR, in_parts, rows, run, views  # noqa: F401

SCHEMA = "id long, name string"


@pytest.fixture
def names(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    kept = Snapshot(spark, str(tmp_path / "names"), schema, width=10)
    table = spark.range(-15, 45).select("id", F.concat(F.lit("n"), "id").alias("name"))
    kept.write(table.union(spark.createDataFrame([(None, "x")], SCHEMA)), 0)
    return kept


def found(df):
    return {r["id"]: r["name"] for r in df.collect()}


def test_a_version_replaces_whole_ranges(spark, names):
    assert found(names.read()) == {i: f"n{i}" for i in range(-15, 45)}
    changed = names.read(spark.createDataFrame([(12,), (None,)], "id long"), before=1)
    assert set(found(changed)) == set(range(10, 20))
    names.write(changed.withColumn("name", F.upper("name")), 1)
    now = found(names.read())
    assert len(now) == 60 and now[12] == "N12" and now[9] == "n9"
    assert names.read(before=1).filter("name = 'n12'").count() == 1


def test_a_version_that_runs_again_replaces_itself(spark, names):
    ids = spark.createDataFrame([(12,)], "id long")
    for letter in "ab":
        names.write(names.read(ids, before=1).withColumn("name", F.concat("name", F.lit(letter))), 1)
    assert found(names.read())[12] == "n12b"


def test_a_version_without_its_manifest_is_not_seen(spark, names):
    data = f"{names.folder}/data/version=1"
    lost = spark.createDataFrame([(12, "lost", 1)], f"{SCHEMA}, range long")
    lost.write.partitionBy("range").parquet(data)
    assert found(names.read())[12] == "n12"


def test_only_wanted_ranges_are_listed(spark, names):
    ids = spark.createDataFrame([(3,), (8,), (41,), (7000,)], "id long")
    files = names.read(ids).inputFiles()
    assert {f.split("range=")[1].split("/")[0] for f in files} == {"0", "4"}
    assert names.read(ids.filter("id > 1000")).count() == 0


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    kept = Snapshot(spark, str(tmp_path / "none"), empty.schema)
    kept.write(empty, 0)
    assert kept.read().collect() == []
    assert kept.read().columns == ["id", "name"]


def test_unlocks_into_a_snapshot(spark, views, in_parts, run, tmp_path):  # noqa: F811
    """Versions after each batch equal the batch operator; the log equals the outcomes."""
    kept = Snapshot(spark, str(tmp_path / "clicks"), views.clicks.schema, width=100)
    kept.write(views.clicks, 0)
    attempts = in_parts(views.unlock_attempts, "click_id", parts=3)
    written = run(
        lambda out, state: live_clicks.stream_unlocks_into(attempts, views.shorturls, kept, out, state)
    )
    outcomes = unlock_outcomes(views.unlock_attempts, views.shorturls, views.clicks)
    assert rows(written.drop("batch")) == rows(outcomes)
    assert rows(kept.read()) == rows(apply_unlocks(views.clicks, outcomes))
    assert outcomes.filter("status = 200").count() > 0
    # A batch rewrites the ranges of clicks it opened and no others.
    opened = outcomes.filter("status = 200").select(kept.range_of(F.col("click_id")).alias("range"))
    changed = kept.ranges().filter("version > 0").select("range")
    assert rows(changed) == rows(opened.distinct())


def test_days_written_again_replace_themselves(spark, views, tmp_path):  # noqa: F811
    folder = str(tmp_path / "days")
    tables.write_clicks(views.clicks, folder, replace=True)
    day = F.to_date("timestamp")
    first = views.clicks.agg(F.min(day)).first()[0]
    tables.write_clicks(views.clicks.filter(day == F.lit(first)), folder, replace=True)
    everything = tables.read_days(
        spark, folder, views.clicks.schema, datetime(1970, 1, 1), datetime(2200, 1, 1)
    )
    assert rows(everything) == rows(views.clicks)


def test_a_time_range_reads_its_days_only(spark):
    between = QUERIES["clicks_between"](spark, SF_DIR)
    plan = between._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    days = {f.split("date=")[1].split("/")[0] for f in between.inputFiles()}
    assert between.count() > 0
    assert days and len(days) >= 7


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Not by one for each folder, as each task reports to the driver."""
    schema = spark.createDataFrame([], SCHEMA).schema
    kept = Snapshot(spark, str(tmp_path / "many"), schema, width=1)
    kept.write(spark.range(90).selectExpr("id", "CAST(id AS STRING) AS name"), 0)
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "")
    try:
        read = kept.read()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)]
    assert tasks and max(tasks) <= sc.defaultParallelism
    assert read.count() == 90
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
