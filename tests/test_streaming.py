"""Streams over several micro-batches give what the batch operator gives on all rows."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickloom import registry
from clickloom.operators import accounts, chat, clicks, traffic
from clickloom.streaming import chat as live_chat
from clickloom.streaming import clicks as live_clicks
from clickloom.streaming import ordered, runner
from clickloom.streaming import traffic as live_traffic

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def views(spark):
    return registry._Views(spark, SF_DIR)


@pytest.fixture
def in_parts(spark, tmp_path):
    """A table as a stream of `parts` files, one per micro-batch, cut by `order`."""

    def make(df, order, parts=2):
        folder = str(tmp_path / f"in-{len(list(tmp_path.iterdir()))}")
        place = F.col(order).cast("double")
        if dict(df.dtypes)[order].startswith("timestamp"):
            place = F.unix_micros(F.col(order).cast("timestamp")).cast("double")
        keyed = df.withColumn("_o", place)
        bounds = keyed.stat.approxQuantile("_o", [i / parts for i in range(1, parts)], 0.0)
        edges = [float("-inf"), *bounds, float("inf")]
        for low, high in zip(edges, edges[1:]):
            part = keyed.filter((F.col("_o") >= low) & (F.col("_o") < high)).drop("_o")
            part.coalesce(1).write.mode("append").parquet(folder)
        return runner.read_stream(spark, folder, df.schema, files_per_batch=1)

    return make


@pytest.fixture
def run(spark, tmp_path):
    def go(start):
        out, state = str(tmp_path / "out"), str(tmp_path / "checkpoint")
        query = start(out, state)
        runner.finish(query)
        assert len({p["batchId"] for p in query.recentProgress}) >= 2
        return spark.read.parquet(out)

    return go


def rows(df, *columns):
    names = columns or sorted(df.columns)
    return Counter(tuple(str(v) for v in r) for r in df.select(*names).collect())


def test_clicks(views, in_parts, run, skewed):
    hits = in_parts(views.link_hits, "id")
    written = run(lambda out, state: live_clicks.stream_clicks(hits, views.shorturls, views.geo, out, state))
    assert rows(written.drop("batch")) == rows(clicks.build_clicks(views.link_hits, views.shorturls, views.geo))


def test_clicks_see_links_added_later(spark, views, in_parts, run, tmp_path):
    """The second batch resolves codes of links that the first one wrote."""
    hits = in_parts(views.link_hits, "id")
    folder = str(tmp_path / "links")
    views.shorturls.filter("id < 0").write.parquet(folder)
    reads = []

    def links():
        if reads:
            views.shorturls.write.mode("append").parquet(folder)
        reads.append(1)
        return spark.read.schema(views.shorturls.schema).parquet(folder)

    written = run(lambda out, state: live_clicks.stream_clicks(hits, links, views.geo, out, state))
    assert len(reads) == 2 and 0 < written.count() < views.clicks.count()


def test_click_totals(views, in_parts, run):
    seen = in_parts(views.clicks, "id")
    written = run(lambda out, state: live_clicks.stream_click_totals(seen, out, state))
    totals = clicks.click_totals(views.shorturls, views.clicks).filter("clicks > 0")
    assert rows(live_clicks.latest_totals(written)) == rows(totals)


def test_rate_limits(views, in_parts, run):
    """Batches cut by id, so that hits come very late and windows span batches."""
    requests = in_parts(views.http_requests, "request_id", parts=3)
    written = run(
        lambda out, state: live_traffic.stream_rate_limit(
            requests, out, state, window_seconds=registry.LIMIT["window_seconds"]
        )
    )
    batch = traffic.window_counts(views.http_requests, **registry.LIMIT)
    found = live_traffic.latest_windows(written, max_hits=registry.LIMIT["max_hits"])
    assert rows(found) == rows(batch)


def test_windows_of_a_key():
    count = ordered.WindowCounter(width=10, most=2)
    hits = [(0, 0, 1), (3, 0, 2), (3, 0, 4), (9, 0, 3), (10, 0, 5)]
    out, kept = count.decide("k", None, hits)
    assert [(i, limited) for i, _, limited in out] == [(1, False), (2, False), (4, True), (3, True), (5, False)]
    assert kept == (10, 1) and count.until(kept) == 20
    out, kept = count.decide("k", kept, [(19, 0, 6), (19, 0, 7), (25, 0, 8)])
    assert [limited for *_, limited in out] == [False, True, False] and kept == (25, 1)


def test_anchored_rate_limit_in_any_order(spark, views, in_parts, run):
    """Cut by id, hits come in any order; a far row lets the last ones be judged."""
    hits = views.http_requests.select("request_id", "ts", "ip")
    far = hits.limit(1).selectExpr(
        "CAST(NULL AS BIGINT) AS request_id", "timestamp_ntz'2200-01-01 00:00:00' AS ts", "ip"
    )
    place = F.coalesce(F.pmod(F.hash("request_id"), F.lit(100)), F.lit(1000)).alias("place")
    requests = in_parts(hits.union(far).select("*", place), "place", parts=3)
    with runner.state_partitions(spark, 2):
        written = run(
            lambda out, checkpoint: live_traffic.stream_rate_limit_anchored(
                requests, out, checkpoint, delay="60 days", **registry.LIMIT
            )
        )
    batch = traffic.rate_limit_anchored(views.http_requests, **registry.LIMIT)
    columns = ("request_id", "ip", "limited")
    assert rows(written, *columns) == rows(batch, *columns)


def test_waiting_events_are_few_rows_of_state(spark, in_parts, tmp_path):
    """Many keys with several hits each wait in a few rows per group; a hit without a key counts too."""
    hits = spark.range(12_000).selectExpr(
        "id AS request_id",
        "IF(id % 3000 = 7, NULL, CONCAT('k', id % 3000)) AS ip",
        "CAST(timestamp_seconds(1600000000 + id div 3000) AS timestamp_ntz) AS ts",
    )
    far = spark.sql("SELECT CAST(NULL AS BIGINT), 'k1', timestamp_ntz'2200-01-01 00:00:00'")
    requests = in_parts(hits.union(far), "ts", parts=3)
    with runner.state_partitions(spark, 2):
        query = live_traffic.stream_rate_limit_anchored(
            requests, str(tmp_path / "out"), str(tmp_path / "c"), delay="1 day", window_seconds=60, max_hits=3
        )
        runner.finish(query)
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(state) < 3000
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 12_000 and written.filter("limited").count() == 3000
    assert written.filter("limited AND request_id < 9000").count() == 0
    assert written.filter("ip IS NULL").count() == 4


def test_unlocks(views, in_parts, run, skewed):
    attempts = in_parts(views.unlock_attempts, "click_id")
    written = run(
        lambda out, state: live_clicks.stream_unlocks(attempts, views.shorturls, views.clicks, out, state)
    )
    outcomes = clicks.unlock_outcomes(views.unlock_attempts, views.shorturls, views.clicks)
    assert rows(written.drop("batch")) == rows(outcomes)
    assert rows(live_clicks.current_clicks(views.clicks, written)) == rows(
        clicks.apply_unlocks(views.clicks, outcomes)
    )


def test_holder_of_a_name():
    held = ordered.NameHolder()
    # 1 holds from 0 to 5; 2 is refused; at 5 its close comes first, 3 has no length, 4 stays.
    events = sorted([(0, 1, 1), (2, 1, 2), (3, 0, 2), (5, 0, 1), (5, 1, 3), (5, 0, 3), (5, 1, 4), (5, 1, 6)])
    out, kept = held.decide("n", None, events)
    assert [(i, kind, at) for i, _, kind, at, _ in out] == [
        (1, "join", 0), (2, "refused", 2), (1, "close", 5),
        (3, "join", 5), (3, "close", 5), (4, "join", 5), (6, "refused", 5),
    ]
    assert kept == (4, 5)
    assert held.decide("n", kept, [(9, 0, 4)]) == ([(4, "n", "close", 9, 5)], None)


def test_events_out_of_order(spark, tmp_path):
    """A close before its open in file order, an instant over two batches, and a row too late."""
    name = '{"username":"n"}'
    parts = [
        [(1, name, "close", 50), (2, name, "open", 50), (7, None, "open", 10), (8, "x", "open", 12)],
        [(1, name, "open", 10), (3, name, "open", 50), (3, name, "close", 60), (8, "x", "close", 13)],
        [(None, None, "tick", 1000), (7, None, "close", 20)],
        [(4, name, "open", 40)],  # its instant is not decided yet, though the clock is beyond
        [(9, name, "open", 30)],
        [(2, name, "close", 1200), (None, None, "tick", 9000)],
    ]
    folder = str(tmp_path / "events")
    for part in parts:
        spark.createDataFrame(part, "conn_id long, first_frame string, kind string, s long").selectExpr(
            "conn_id", "first_frame", "kind", "CAST(timestamp_seconds(s) AS timestamp_ntz) AS ts"
        ).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    with runner.state_partitions(spark, 2):
        query = live_chat.stream_connections(
            runner.read_stream(spark, folder, schema, files_per_batch=1),
            str(tmp_path / "out"), str(tmp_path / "checkpoint"), delay="100 seconds",
        )
        runner.finish(query)
    log = spark.read.parquet(str(tmp_path / "out"))
    found = {(r.conn_id, r.kind, r.ts.minute * 60 + r.ts.second) for r in log.collect()}
    assert found == {
        (1, "join", 10), (1, "close", 50), (2, "join", 50), (3, "refused", 50), (2, "close", 1200), (4, "refused", 40),
        (7, "open", 10), (7, "close", 20), (8, "refused", 12),
    }
    assert log.count() == len(found) and ordered.late_rows(query) == 1
    admissions = {r.conn_id: (r.admitted, r.error) for r in live_chat.admissions_of(log).collect()}
    assert admissions == {
        1: (True, None), 2: (True, None), 3: (False, chat.TAKEN_USERNAME), 4: (False, chat.TAKEN_USERNAME),
        7: (False, None), 8: (False, chat.BAD_USERNAME_FRAME),
    }


def test_first_writer(views, in_parts, run):
    requests = accounts.complete_requests(in_parts(views.signup_requests, "request_id"))
    written = run(
        lambda out, state: live_traffic.stream_first_writer(
            requests, "username", views.users, out, state
        )
    )
    outcomes = accounts.register(views.signup_requests, views.users)[0].filter("status = 200")
    assert rows(live_traffic.first_writers(written, "username"), "request_id") == rows(
        outcomes, "request_id"
    )


def test_a_batch_that_runs_again_replaces_its_rows(spark, in_parts, tmp_path):
    out, written = str(tmp_path / "again"), []

    def twice(rows, batch_id):
        rows.write.mode("overwrite").parquet(runner.batch_folder(out, batch_id))
        written.append(batch_id)
        return rows

    df = spark.range(30).withColumnRenamed("id", "n")
    query = runner.per_batch(
        in_parts(df, "n"), out, str(tmp_path / "c"), transform=twice
    )
    runner.finish(query)
    assert len(written) == 2
    assert spark.read.parquet(out).count() == 30


def test_costly_rows_are_read_in_parallel(spark, tmp_path, monkeypatch):
    """What is parsed row by row is stored in a file per core, and live batches are too."""
    v = registry._Views(spark, "/root/testdata/sf0.01")
    cores = spark.sparkContext.defaultParallelism
    assert len(v.chat_conns.inputFiles()) >= cores and len(v.chat_frames.inputFiles()) >= cores
    monkeypatch.setattr(registry, "new_folder", lambda _, name: str(tmp_path / name))
    v.stream_out_of_order("chat_frames", lambda: v.chat_frames, ["frame_id"])
    files = spark.read.parquet(str(tmp_path / "chat_frames-arriving")).inputFiles()
    assert len(files) > registry.MICRO_BATCHES * cores


def simple_holders(events):
    """Joins, refusals and closes of one name, gone through event by event."""
    out, kept, closes = [], None, {(at, i) for at, rank, i in events if not rank}
    for at, rank, i in events:
        if rank and kept:
            out.append((i, "refused", at))
        elif rank:
            out += [(i, "join", at), (i, "close", at)] if (at, i) in closes else [(i, "join", at)]
            kept = None if (at, i) in closes else (i, at)
        elif kept and kept[0] == i:
            out.append((i, "close", at))
            kept = None
    return out, kept


def test_holders_of_many_names():
    """All names of a group at once, over several rounds, as each name event by event."""
    draw = random.Random(5)
    held, simple, rule = {}, {}, ordered.NameHolder()

    def sort_key(e):
        return (e[0] is not None, e[0] or "", *e[1:])

    for begin in (0, 20, 40):
        events = sorted(
            (
                (draw.choice(["a", "b", "c", None]), begin + draw.randrange(20), draw.randrange(2), draw.randrange(9))
                for _ in range(300)
            ),
            key=sort_key,
        )
        shuffled = draw.sample(events, len(events))
        table = pa.Table.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*shuffled), ordered.WAITING)], schema=ordered.WAITING
        )
        found = rule.judge(table, held)
        for name in ("a", "b", "c", None):
            own = [e[1:] for e in events if e[0] == name]
            before = simple.get(name)
            # Who holds the name from before stands first.
            told, now = simple_holders([(-1, 1, before[0]), *own] if before else own)
            told = told[1:] if before else told
            simple[name] = (now[0], before[1] if before and now[1] == -1 else now[1]) if now else None
            mine = found[found["_name"].isna()] if name is None else found[found["_name"] == name]
            assert list(mine[["_id", "_kind", "_at"]].itertuples(index=False, name=None)) == told
        assert held == {n: k for n, k in simple.items() if k}


def test_connections_are_judged_once(spark, in_parts, tmp_path):
    """Events are read once, also those without a name, which are never too late."""
    named = "IF(id % 3 = 0, CONCAT('{\"username\":\"n', id, '\"}'), IF(id % 3 = 1, NULL, 'x')) AS first_frame"
    conns = spark.range(600).selectExpr(
        "id AS conn_id", named,
        "CAST(timestamp_seconds(1600000000 + id * 100) AS timestamp_ntz) AS open_ts",
        "CAST(timestamp_seconds(1600000050 + id * 100) AS timestamp_ntz) AS close_ts",
    )
    far = spark.sql("SELECT CAST(NULL AS BIGINT), CAST(NULL AS STRING), 'tick', timestamp_ntz'2200-01-01 00:00:00'")
    late = spark.sql("SELECT 1000L, CAST(NULL AS STRING), 'open', timestamp_ntz'1999-01-01 00:00:00'")
    events = live_chat.connection_events(conns).union(far).union(late)
    placed = events.selectExpr("*", "IF(kind = 'tick', 500, IF(conn_id = 1000, 1000, conn_id % 7)) AS place")
    with runner.state_partitions(spark, 2, 100):
        query = live_chat.stream_connections(
            in_parts(placed, "place", parts=3), str(tmp_path / "out"), str(tmp_path / "c"), delay="1 day"
        )
        runner.finish(query)
    assert sum(p["numInputRows"] for p in query.recentProgress) == events.count()
    log = spark.read.parquet(str(tmp_path / "out"))
    found = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert found == {"join": 200, "close": 400, "open": 201, "refused": 200}
    assert ordered.late_rows(query) == 0
    told = log.filter("conn_id = 2").collect()
    assert [(r.kind, r.error, r.username, r.since) for r in told] == [("refused", chat.BAD_USERNAME_FRAME, None, None)]


def test_frames_meet_the_intervals_they_lie_in(spark, tmp_path):
    """Frames and intervals in any order over micro-batches, in a few rows of state."""
    said = '{"type":"message","message":"hi"}'
    frames = [
        [(1, 7, 20, said), (2, 7, 50, said), (3, 7, 51, said), (4, None, 20, said), (5, 9, 20, said), (6, 7, 20, "x")],
        [(7, 7, 49, said), (8, 8, 30, said)] + [(k, k, 60, said) for k in range(1000, 4000)],
        [(None, None, 9000, None)],
        [(9, 7, 30, said)],  # beyond the delay, but not yet left out
        [(10, 7, 31, said)],  # too late
    ]
    log = [
        [(8, "close", "b", 30, 31), (5, "join", "e", 20, 20)],
        [(7, "close", "a", 50, 10), (8, "close", None, 40, None), (9, "close", "c", 500, 19), (9, "close", "c", 15, 15)],
        [(None, "tick", None, 9000, None)],
        [(9, "close", "d", 9500, 1)],
    ]
    time = "CAST(timestamp_seconds({0}) AS timestamp_ntz)".format
    folders = [str(tmp_path / "frames"), str(tmp_path / "log")]
    for part in frames:
        rows_ = spark.createDataFrame(part, "frame_id long, conn_id long, s long, frame string")
        rows_ = rows_.selectExpr("frame_id", "conn_id", f"{time('s')} AS ts", "frame")
        rows_.coalesce(1).write.mode("append").parquet(folders[0])
    for part in log:
        rows_ = spark.createDataFrame(part, "conn_id long, kind string, username string, s long, f long")
        rows_ = rows_.selectExpr("conn_id", "username", "kind", f"{time('s')} AS ts", f"{time('f')} AS since")
        rows_.coalesce(1).write.mode("append").parquet(folders[1])
    streams = [runner.read_stream(spark, f, spark.read.parquet(f).schema, files_per_batch=1) for f in folders]
    with runner.state_partitions(spark, 2):
        query = live_chat.stream_senders(
            *streams, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "100 seconds", "1000 seconds"
        )
        runner.finish(query)
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    found = {r.frame_id: (r.conn_id, r.ts.minute * 60 + r.ts.second, r.username, r.message) for r in written}
    assert len(written) == len(found) == 3008
    assert {k: v for k, v in found.items() if k < 1000} == {
        1: (7, 20, "a", "hi"), 2: (7, 50, None, "hi"), 3: (7, 51, None, "hi"), 4: (None, 20, None, "hi"),
        5: (9, 20, "c", "hi"), 7: (7, 49, "a", "hi"), 8: (8, 30, None, "hi"),
        9: (7, 30, "a", "hi"),
    }
    state = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(state) <= ordered.GROUPS
