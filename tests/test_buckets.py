"""Clicks stored in buckets of the code."""

import uuid

import pytest
from pyspark.sql import functions as F

from clickloom.operators import clicks, links
from clickloom.sources.buckets import Buckets
from tests.test_streaming import rows, views  # noqa: F401

SCHEMA = "id long, code string"


@pytest.fixture
def stored(spark, skewed, tmp_path):
    """One code holds a third of the rows, and some rows have none."""
    code = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
        F.concat(F.lit("c"), (F.col("id") % 40).cast("string"))
    )
    table = spark.range(600).select("id", code.alias("code"))
    kept = Buckets(spark, f"codes_{uuid.uuid4().hex}", "code").write(table, str(tmp_path / "t"), 4)
    return kept, table


def test_a_hot_key_lies_in_several_buckets(stored):
    kept, table = stored
    assert rows(kept.rows()) == rows(table)
    assert kept.heavy().filter("code = 'hot'").count() == 1
    hot = kept.spark.table(kept.name).filter("code = 'hot'")
    assert len(hot.inputFiles()) > 1
    assert hot.select("_salt").distinct().count() > 1
    files = hot.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 200


def test_joins_on_the_key(spark, stored):
    kept, table = stored
    asked = spark.createDataFrame([("hot",), ("c5",), ("c5",), ("none",), (None,)], "code string")
    given = ["hot", "c5"]
    assert rows(kept.with_keys(asked)) == rows(table.filter(F.col("code").isin(given)))
    others = table.filter(F.col("code").isNull() | ~F.col("code").isin(given))
    assert rows(kept.without_keys(asked)) == rows(others)
    assert sorted(r[0] for r in kept.keys_in_use(asked).collect()) == sorted(given)


def test_no_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    kept = Buckets(spark, f"codes_{uuid.uuid4().hex}", "code").write(empty, str(tmp_path / "t"), 4)
    some = spark.createDataFrame([("a",)], "code string")
    assert kept.with_keys(some).collect() == kept.without_keys(some).collect() == []
    assert kept.keys_in_use(some).collect() == []


def _above_scan(df, name):
    """Operators from the scan of a table up to the first join above it."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [next((i for i, c in enumerate(line) if c.isalpha()), 0) for line in lines]
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and f"{name}[" in line)
    path = []
    for i in range(at - 1, -1, -1):
        if depth[i] < depth[at]:
            path.append(lines[i])
            at = i
            if "Join" in lines[i]:
                return path
    raise AssertionError("no join")


@pytest.mark.parametrize("query", ["listing", "removal", "outcome"])
def test_stored_rows_are_not_moved(spark, views, skewed, tmp_path, query):  # noqa: F811
    kept = Buckets(spark, f"clicks_{uuid.uuid4().hex}", "shorturl")
    kept.write(views.clicks, str(tmp_path / "clicks"), 8)
    found = {
        "listing": lambda c: clicks.clicks_for(c, views.click_requests),
        "removal": lambda c: links.remove_links(views.remove_requests, views.shorturls, c)[2],
        "outcome": lambda c: clicks.analytics_outcome(views.click_requests, c, views.shorturls),
    }[query]
    bucketed = found(kept)
    assert not any("Exchange" in line for line in _above_scan(bucketed, kept.name))
    assert rows(bucketed) == rows(found(views.clicks))
