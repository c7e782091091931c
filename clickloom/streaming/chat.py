"""Admission, presence and fan-out on live connection events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions.rules import from_micros, micros
from clickloom.operators.chat import (
    TAKEN_USERNAME,
    check_frame,
    join_rules,
    open_connections,
    seen_holders,
    user_lists,
)
from clickloom.plans.timeline import count_open, stab
from clickloom.streaming.ordered import NameHolder, in_order
from clickloom.streaming.runner import per_batch
from clickloom.streaming.spans import points_in_spans


def connection_events(conns: DataFrame) -> DataFrame:
    """Open and close events of connections: (conn_id, first_frame, kind, ts)."""
    events = F.array(
        F.struct(F.lit("open").alias("kind"), F.col("open_ts").alias("ts")),
        F.struct(F.lit("close").alias("kind"), F.col("close_ts").alias("ts")),
    )
    return conns.select("conn_id", "first_frame", F.explode(events).alias("e")).select(
        "conn_id", "first_frame", "e.kind", "e.ts"
    )


def stream_connections(
    events: DataFrame, out: str, checkpoint: str, delay: str = "1 minute", **options
) -> StreamingQuery:
    """Write what becomes of each connection, from `connection_events`: a log of
    (conn_id, username, kind, ts, since, error).

    Kinds are `join` (admitted), `refused` (with its error), `open` (no frame, so no name)
    and `close` (of all but refused ones, with `since` for those with a name). Events may
    come up to `delay` late, in any order: a name's events wait in its state until the
    watermark has passed them. Connections without a name to hold have no state.
    """
    judged = events.select(
        "conn_id", "kind", micros(F.col("ts")).alias("_at"), join_rules(F.col("first_frame")).alias("_j")
    )
    clock = F.col("kind") == "tick"
    name = F.col("_j.username")
    # All rows go one way, as what is judged for a filter would be judged once more behind it.
    written = in_order(
        judged, F.coalesce(name, F.col("_j.error")), F.col("_at"), (F.col("kind") == "open").cast("int"),
        F.when(~clock, F.col("conn_id")), delay, NameHolder(), apart=name.isNull() & ~clock,
    ).select(
        F.col("_id").alias("conn_id"),
        F.col("_name").alias("username"),
        F.col("_kind").alias("kind"),
        from_micros(F.col("_at")).alias("ts"),
        from_micros(F.col("_since")).alias("since"),
        F.when(F.col("_kind") == "refused", F.coalesce("_error", F.lit(TAKEN_USERNAME))).alias("error"),
    )
    return per_batch(written, out, checkpoint, "append", **options)


def admissions_of(log: DataFrame) -> DataFrame:
    """Connections of a log: (conn_id, username, open_ts, close_ts, admitted, error), so far.

    One that has not closed is taken to be open one second beyond the log's last event.
    """
    closes = log.filter("kind = 'close'").select("conn_id", F.col("ts").alias("_closed"))
    opened = log.filter("kind <> 'close'").select(
        "conn_id",
        "username",
        F.col("ts").alias("open_ts"),
        (F.col("kind") == "join").alias("admitted"),
        "error",
    )
    beyond = log.agg(F.max("ts") + F.expr("INTERVAL '1' SECOND")).scalar()
    return opened.join(closes, "conn_id", "left").select(
        "conn_id", "username", "open_ts", F.coalesce("_closed", beyond).alias("close_ts"), "admitted", "error"
    )


def lists_of(log: DataFrame) -> DataFrame:
    """User list after each admission, refusal and close of a log."""
    kind = F.when(F.col("kind") == "join", "join").otherwise("close").alias("kind")
    changes = log.filter("kind <> 'open'").select("conn_id", kind, "ts")
    return user_lists(changes, seen_holders(admissions_of(log)))


def stream_senders(
    frames: DataFrame, log: DataFrame, out: str, checkpoint: str, delay: str, longest: str, **options
) -> StreamingQuery:
    """Write each accepted frame with the name of its sender, NULL if nobody held it then.

    `frames` and `log` (of `stream_connections`) are streams, joined on the connection
    where the frame was sent within an interval. An interval is told when it ends, at most
    `longest` after a frame within it; a frame that no interval has met by then comes out
    without a sender. Rows with a NULL id only move the clock.
    """
    judged = F.array(F.struct(*check_frame(frames).columns))
    told = lambda f: f["frame_id"].isNull() | (f["status"] == "accepted")
    # Not by a filter, which would judge each frame again.
    accepted = check_frame(frames).select(F.explode(F.filter(judged, told)).alias("f")).select("f.*")
    sent_at = F.timestamp_micros(micros(F.col("ts")))
    sent = accepted.select(
        F.col("frame_id").alias("id"), F.col("conn_id").alias("key"), sent_at.alias("at"),
        (sent_at + F.expr(f"INTERVAL {longest}")).alias("until"), F.col("message").alias("text"),
    )
    held = log.filter("kind IN ('close', 'tick')").select(
        F.col("conn_id").alias("key"),
        F.timestamp_micros(micros(F.coalesce("since", "ts"))).alias("start"),
        F.timestamp_micros(micros(F.col("ts"))).alias("end"),
        F.col("username").alias("text"),
    )
    joined = points_in_spans(sent, held, delay).select(
        F.col("_id").alias("frame_id"), F.col("_key").alias("conn_id"), from_micros(F.col("_at")).alias("ts"),
        F.col("_found").alias("username"), F.col("_text").alias("message"),
    )
    return per_batch(joined, out, checkpoint, "append", **options)


def delivery_counts_of(sent: DataFrame, log: DataFrame) -> DataFrame:
    """Number of recipients of each frame with a sender."""
    recipients = open_connections(admissions_of(log))
    return count_open(
        sent.filter("username IS NOT NULL").select("frame_id", "ts"),
        "ts", recipients, "open_ts", "close_ts", "recipients",
    ).select("frame_id", "recipients")


def fan_out_of(sent: DataFrame, log: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """One row per frame with a sender and connection that gets it."""
    recipients = open_connections(admissions_of(log))
    return stab(
        sent.filter("username IS NOT NULL").select("frame_id", "ts"),
        recipients, "ts", "open_ts", "close_ts", "inner", bucket_seconds,
    ).select("frame_id", "recipient_conn")
