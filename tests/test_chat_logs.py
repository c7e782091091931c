"""User lists and recipients from logs of changes."""

import pytest
from pyspark.sql import functions as F

from clickloom import registry
from clickloom.operators import chat

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_lists_from_a_log(spark, size):
    """Lists rebuilt from pages of any size are those made at once, ties included."""
    v = registry._Views(spark, SF_DIR)
    some = v.admissions.filter("conn_id % 20 < 3")
    minute = F.date_trunc("hour", "open_ts").cast("timestamp_ntz")
    tied = some.withColumn("open_ts", minute).withColumn(
        "close_ts", F.greatest("open_ts", F.date_trunc("hour", "close_ts").cast("timestamp_ntz"))
    )
    log = chat.presence_log(tied, size).cache()
    found = {(r["conn_id"], r["kind"]): r for r in chat.lists_of_log(log).collect()}
    expected = chat.presence(tied).collect()
    assert len(found) == len(expected) > 0
    for row in expected:
        mine = found[row["conn_id"], row["kind"]]
        assert (mine["ts"], mine["users"], mine["online"]) == (row["ts"], row["users"], row["online"])
    pages = log.filter("kind <> 'online'").groupBy("page", "ts").count().collect()
    last = {}
    for r in sorted(pages, key=lambda r: r["ts"]):
        last.setdefault(r["page"], []).append(r["count"])
    assert all(sum(counts[:-1]) < size or len(counts) == 1 for counts in last.values())
    log.unpersist()


def test_recipients_from_versions(spark):
    """Expanded, versions give the pairs of fan_out."""
    v = registry._Views(spark, SF_DIR)
    found = chat.fan_out_versions(v.chat_frames, v.admissions).collect()
    spans, messages = {}, []
    for kind, key, version in found:
        if kind == "message":
            messages.append((key, version))
        else:
            spans.setdefault(key, {})[kind] = version
    pairs = {
        (frame, conn)
        for frame, at in messages
        for conn, span in spans.items()
        if span["open"] <= at < span["close"]
    }
    expected = {tuple(r) for r in chat.fan_out(v.chat_frames, v.admissions).collect()}
    assert pairs == expected and expected
    assert len(found) == len(messages) + 2 * len(spans)


def test_frames_meet_connections_before_they_are_parsed(spark):
    v = registry._Views(spark, SF_DIR)
    sent = chat.sent_messages(v.chat_frames, v.admissions)
    plan = sent._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join Inner") :].split("\n", 1)[1]
    assert "RLIKE" in plan.upper() and "RLIKE" not in below.upper()
    admitted = {r.conn_id: r for r in v.admissions.filter("admitted").collect()}
    frames = chat.check_frame(v.chat_frames).filter("status = 'accepted'").collect()
    expected = {
        (f.frame_id, f.message)
        for f in frames
        if (c := admitted.get(f.conn_id)) and c.open_ts <= f.ts < c.close_ts
    }
    assert {(r.frame_id, r.message) for r in sent.collect()} == expected and expected


def test_first_frames_are_checked_once(spark):
    v = registry._Views(spark, SF_DIR)
    given = v.stored("checked_conns", lambda: chat.check_join(v.chat_conns))
    found = chat.admit(v.chat_conns, checked=given)
    assert "rlike" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, chat.admit(v.chat_conns).collect()))
