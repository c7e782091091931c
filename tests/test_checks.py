"""Every registered query against its SQL on the given tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from clickloom.oracle import oracle_texts
from clickloom.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "part", "orders", "events", "pages"]

ORACLE = oracle_texts()

# Queries whose plan has a salted or sliced form.
SPREAD = [
    "message_frames",
    "add_links",
    "resolve_owner",
    "remove_links",
    "number_links",
    "enrich_geo",
    "build_clicks",
    "clicks_for",
    "analytics_outcome",
    "unlock_outcomes",
    "rate_limit_anchored",
    "admit",
    "presence",
    "fan_out",
    "delivery_counts",
    "presence_log",
    "presence_from_log",
    "fan_out_versions",
]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(SF_DIR) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _check(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    rows = Counter(tuple(r) for r in found.select(*columns).collect())
    expected = duck.execute(ORACLE[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == Counter(tuple(r[i] for i in places) for r in expected.fetchall())
    assert rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    _check(spark, duck, name)


@pytest.mark.parametrize("name", SPREAD)
def test_spread_plan_equals_sql(spark, duck, skewed, name):
    _check(spark, duck, name)


def test_every_check_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLE) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if not n.startswith("stream_")])
def test_no_pairwise_joins(spark, skewed, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_what_is_asked(spark):
    plan = QUERIES["click_totals"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "isp" not in plan and "useragent" not in plan
    assert "partial_count" in plan
