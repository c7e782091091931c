"""The skew-safe building blocks against brute force."""

import random
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.functions.rules import micros
from clickloom.operators.links import flag_filtered
from clickloom.operators.traffic import rate_limit_anchored
from clickloom.plans import numbering, skew, timeline
from clickloom.plans.chains import greedy_intervals

START = datetime(2024, 3, 10, 1, 0)


def _greedy(rows):
    """Ids chosen one by one: rows are (key, start, end, id)."""
    chosen, free = [], {}
    for key, start, end, row_id in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        if key not in free or start >= free[key]:
            chosen.append(row_id)
            free[key] = end
    return sorted(chosen)


def _random_intervals(seed, n, span, longest):
    draw = random.Random(seed)
    rows = []
    for row_id in range(n):
        key = draw.choice(["hot", "hot", "hot", "warm", f"cold{draw.randrange(20)}"])
        start = draw.randrange(span) * 1_000_000
        rows.append((key, start, start + draw.randrange(longest) * 1_000_000, row_id))
    return rows


@pytest.mark.parametrize(
    "seed, slices", [(0, 300), (1, 100), (1, 7), (2, 64), (3, 1024), (0, 1)]
)
def test_greedy_intervals(spark, settings, seed, slices):
    # Small Arrow batches, so groups go on from one to the next.
    settings(
        clickloom__heavyRows=20,
        clickloom__heavyKeys=2,
        spark__sql__execution__arrow__maxRecordsPerBatch=7,
    )
    rows = _random_intervals(seed, 400, 300 if seed % 2 else 3000, 2 if seed == 3 else 40)
    df = spark.createDataFrame(rows, "key string, s long, e long, id long")
    got = greedy_intervals(df, F.col("key"), F.col("s"), F.col("e"), F.col("id"), slices)
    assert sorted(r.id for r in got.filter("taken").collect()) == _greedy(rows)
    ends = {r[3]: r[2] for r in rows}
    for row in got.filter("taken").collect():
        assert row.until == ends[row.id]


def test_anchored_limit_of_a_hot_key(spark, settings):
    settings(
        clickloom__heavyRows=50,
        spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__execution__arrow__maxRecordsPerBatch=13,
    )
    draw = random.Random(5)
    hits = [
        (i, draw.choice(["a", "a", "a", "b", ""]), START + timedelta(milliseconds=draw.randrange(90_000)))
        for i in range(900)
    ]
    df = spark.createDataFrame(hits, "request_id long, ip string, ts timestamp_ntz")
    got = rate_limit_anchored(df, window_seconds=7, max_hits=4, slices=20)
    opened, seen, expected = {}, {}, {}
    for row_id, key, ts in sorted(hits, key=lambda h: (h[2], h[0])):
        if key not in opened or ts >= opened[key] + timedelta(seconds=7):
            opened[key], seen[key] = ts, 0
        seen[key] += 1
        expected[row_id] = seen[key] > 4
    assert {r.request_id: r.limited for r in got.collect()} == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_spreads_hot_keys_and_copies(spark, skewed, how):
    # Identical copies, NULL keys, unknown keys and a lookup key stored twice.
    facts = [("hot", 1)] * 40 + [("warm", i) for i in range(6)] + [(None, 2)] * 9 + [("none", 3)]
    lookups = [("hot", "x"), ("warm", "y"), ("warm", "z"), ("unused", "u")]
    fact = spark.createDataFrame(facts, "k string, v long").repartition(8)
    lookup = spark.createDataFrame(lookups, "k string, w string")
    expected = Counter()
    for key, value in facts:
        found = [w for k, w in lookups if k == key]
        if how == "left_semi":
            expected[(key, value)] += bool(found)
        elif how == "left_anti":
            expected[(key, value)] += not found
        else:
            for w in found or ([None] if how == "left" else []):
                expected[(key, value, w)] += 1
    got = skew.lookup_join(fact, lookup, ["k"], how)
    assert Counter(tuple(r) for r in got.collect()) == +expected


def test_salts_reach_hot_and_null_keys_only(spark, skewed):
    fact = spark.createDataFrame(
        [("hot", 1)] * 50 + [(None, 1)] * 50 + [("cold", 1)], "k string, v long"
    ).repartition(8)
    heavy = skew.heavy_keys(fact, ["k"])
    salted = skew.salt_rows(fact, heavy, ["k"]).groupBy("k").agg(F.countDistinct("_salt").alias("n"))
    salts = {r.k: r.n for r in salted.collect()}
    assert salts["cold"] == 1
    assert salts["hot"] > 1 and salts[None] > 1


def test_plan_of_a_small_lookup_is_a_broadcast(spark):
    fact = spark.range(100).withColumnRenamed("id", "k")
    plan = skew.lookup_join(fact, spark.range(5).select(F.col("id").alias("k"), "id"), ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "_salt" not in text


@pytest.mark.parametrize("id_range", [3, 1000])
def test_sequence_number(spark, id_range):
    ids = random.Random(1).sample(range(-50, 200), 120)
    rows = [(i, None if i % 7 == 0 else f"t{i % 3}") for i in ids]
    df = spark.createDataFrame(rows, "id long, token string").repartition(5)
    places, expected = Counter(), {}
    for i, token in sorted(rows):
        places[token] += 1
        expected[i] = places[token]
    got = numbering.sequence_number(df, "id", ["token"], id_range=id_range)
    assert {r.id: r.seq for r in got.collect()} == expected
    overall = numbering.sequence_number(df, "id", id_range=id_range)
    assert {r.id: r.seq for r in overall.collect()} == {i: n for n, i in enumerate(sorted(ids), 1)}


def test_next_ids_follow_the_highest(spark):
    current = spark.createDataFrame([(4,), (9,)], "id long")
    new = spark.createDataFrame([(30,), (10,), (20,)], "request_id long")
    got = numbering.with_next_ids(current, new, "request_id")
    assert {(r.request_id, r.id) for r in got.collect()} == {(10, 10), (20, 11), (30, 12)}
    first = numbering.with_next_ids(current.filter("id < 0"), new, "request_id")
    assert {r.id for r in first.collect()} == {1, 2, 3}


@pytest.mark.parametrize("n", [2, 1500])
def test_first_n(spark, n):
    rows = [(i % 2, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(6)
    got = numbering.first_n(df, ["k"], ["id"], n).drop("_rank")
    assert sorted(tuple(r) for r in got.collect()) == sorted(
        (k, i) for k in (0, 1) for i in [i for q, i in rows if q == k][:n]
    )


def test_first_n_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = numbering.first_n(df, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _times(seed, n, minutes):
    draw = random.Random(seed)
    opened = [START + timedelta(seconds=draw.randrange(minutes * 60)) for _ in range(n)]
    return [(i, a, a + timedelta(seconds=draw.choice([0, 1, 59, 4000]))) for i, a in enumerate(opened)]


def test_count_open_and_stab(spark, skewed):
    conns = _times(2, 60, 200)
    points = [(i, START + timedelta(seconds=random.Random(i).randrange(13000))) for i in range(300)]
    points += [(1000 + i, START + timedelta(minutes=5)) for i in range(40)]
    intervals = spark.createDataFrame(conns, "conn long, s timestamp_ntz, e timestamp_ntz")
    frames = spark.createDataFrame(points, "id long, ts timestamp_ntz")
    pairs = Counter((i, c) for i, t in points for c, a, b in conns if a <= t < b)
    counted = timeline.count_open(frames, "ts", intervals, "s", "e", "n")
    expected = {i: sum(1 for j, _ in pairs if j == i) for i, _ in points}
    assert {r.id: r.n for r in counted.collect()} == expected
    got = timeline.stab(frames, intervals, "ts", "s", "e", bucket_seconds=600)
    assert Counter((r.id, r.conn) for r in got.collect()) == pairs
    levels = timeline.open_counts(intervals, "s", "e")
    real = [(a, b) for _, a, b in conns if a < b]
    instants = {t for pair in real for t in pair}
    assert {r.ts: r.total for r in levels.collect()} == {
        t: sum(1 for a, b in real if a <= t < b) for t in instants
    }


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_micros_ignore_the_session_zone(spark, settings, zone):
    settings(spark__sql__session__timeZone=zone)
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.123456' AS ts")
    assert df.select(micros(F.col("ts"))).first()[0] == 1710037800123456


@pytest.mark.parametrize("spread", [False, True])
def test_flag_filtered(spark, request, spread):
    if spread:
        request.getfixturevalue("skewed")
    words = spark.createDataFrame([("Ring",), ("a b",), ("xyz",)], "word string")
    texts = ["string", "SPRINGS", "xa by", "rin", "", None, "axyz", "ring"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id long, code string")
    got = {r.id: r.filtered for r in flag_filtered(df, "code", words).collect()}
    flags = {"string": True, "SPRINGS": True, "xa by": True, "axyz": True, "ring": True, None: None}
    assert got == {i: flags.get(t, False) for i, t in enumerate(texts)}
    none = flag_filtered(df, "code", words.limit(0)).collect()
    assert {r.filtered for r in none if r.code is not None} == {False}


def test_worker_functions_need_no_installed_package(tmp_path):
    """What runs in Python workers is sent by value."""
    from pyspark import cloudpickle

    from clickloom.plans import chains

    path = tmp_path / "functions.pickle"
    path.write_bytes(cloudpickle.dumps([chains._step_tables, chains._block_tables, chains._entry_times, chains._choose]))
    load = f"import pickle; print(len(pickle.load(open({str(path)!r}, 'rb'))))"
    done = subprocess.run(
        [sys.executable, "-c", load], capture_output=True, text=True, cwd=tmp_path, timeout=120
    )
    assert done.stdout.strip() == "4", done.stderr


def test_total_before(spark, monkeypatch):
    """Totals before each place, over blocks, with and without keys (a missing one too)."""
    monkeypatch.setattr(numbering, "BLOCK_PLACES", 4)
    draw = random.Random(8)
    rows = [(k, p, draw.randint(-5, 9)) for k in ("a", None, "b") for p in draw.sample(range(-30, 60), 25)]
    df = spark.createDataFrame(rows, "k string, p long, n long")
    for r in numbering.total_before(df, ["k"], "p", "n", "before").collect():
        assert r.before == sum(n for k, p, n in rows if k == r.k and p < r.p)
    one = df.filter("k = 'a'").drop("k")
    for r in numbering.total_before(one, [], "p", "n", "before").collect():
        assert r.before == sum(n for k, p, n in rows if k == "a" and p < r.p)
