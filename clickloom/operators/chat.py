"""Chat connections, presence and message fan-out from connection events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rules import js_trim, micros
from clickloom.plans.chains import SLICES, greedy_intervals
from clickloom.plans.skew import lookup_join
from clickloom.plans.timeline import count_open, in_pages, open_counts, stab

# Texts sent to the connection.
BAD_USERNAME_FRAME = "Invalid username format."
NO_USERNAME = "First message must include a username."
EMPTY_USERNAME = "Username cannot be empty."
TAKEN_USERNAME = "Username is already taken. Please choose another."
BAD_FRAME = "Invalid message format."

# After every event.
END_OF_TIME = "9999-01-01 00:00:00"

# Changes of one page of the presence log.
PAGE_ROWS = 100_000

# How a JSON text can begin.
JSON_START = r"\A[ \t\r\n]*(?:[\[{\"\-0-9]|true|false|null)"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once per row, wherever a filter moves it."""
    return F.get(F.transform(F.array(value), use), 0)


# The fields that are read from a frame.
_FIELDS = "username variant, type variant, message variant, broken string"


def _parsed(frame: Column) -> Column:
    """Frame as a variant, NULL for bad JSON; texts that cannot be JSON are not tried.

    The variant parser refuses an object that names a key twice. Such a frame is read
    field by field, where the last value of a key counts.
    """
    again = F.from_json(frame, _FIELDS, {"columnNameOfCorruptRecord": "broken"})
    last = F.when(
        frame.rlike(r"\A[ \t\r\n]*\{") & again["broken"].isNull() & again.isNotNull(),
        F.try_parse_json(F.to_json(again)),
    )
    return F.when(frame.rlike(JSON_START), F.coalesce(F.try_parse_json(frame), last))


def _raw(frame: Column) -> Column:
    """The texts of a frame's fields, where an object inside it names a key twice.

    A variant cannot hold such an object, but its text can be judged: it is an object or
    array, so it counts as true and is no text. NULL for bad JSON.
    """
    fields = F.from_json(
        frame, _FIELDS.replace("variant", "string"), {"columnNameOfCorruptRecord": "broken"}
    )
    return F.when(frame.rlike(r"\A[ \t\r\n]*\{") & fields["broken"].isNull(), fields)


_NESTED = r"\A[ \t\r\n]*[\[{]"
_FALSE = ["", "0", "-0", "0.0", "false"]


def _field(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def _text(value: Column) -> Column:
    """Text of a variant that is a JSON string, NULL for any other type or a missing key."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _unreadable(document: Column) -> Column:
    """Bad JSON, or JSON null, which has no fields to read."""
    return document.isNull() | F.is_variant_null(document)


def join_rules(frame: Column) -> Column:
    """Trimmed user name and error text of a first frame; one of them is NULL."""

    def judge(document: Column) -> Column:
        raw = _raw(frame)
        named = F.when(~raw["username"].rlike(_NESTED), raw["username"])
        text = F.when(document.isNull(), named).otherwise(_text(_field(document, "username")))
        bad = F.when(document.isNull(), raw.isNull()).otherwise(_unreadable(document))
        return F.when(
            frame.isNull(), F.struct(F.lit(None).cast("string"), F.lit(None).cast("string"))
        ).when(
            bad, F.struct(F.lit(None).cast("string"), F.lit(BAD_USERNAME_FRAME))
        ).otherwise(
            _bound(
                text,
                lambda t: F.when(
                    F.coalesce(t, F.lit("")) == "",
                    F.struct(F.lit(None).cast("string"), F.lit(NO_USERNAME)),
                ).otherwise(
                    _bound(
                        js_trim(t),
                        lambda name: F.struct(
                            F.when(name != "", name), F.when(name == "", F.lit(EMPTY_USERNAME))
                        ),
                    )
                ),
            )
        )

    return _bound(_parsed(frame), judge).cast("struct<username:string,error:string>")


def check_join(conns: DataFrame) -> DataFrame:
    """Add `username` and `error` from the first frame of each connection.

    A connection that has sent no frame (NULL) has neither: it stays open without a name.
    """
    return conns.select("*", join_rules(F.col("first_frame")).alias("_j")).select(
        *conns.columns, "_j.username", "_j.error"
    )


def chosen_holders(named: DataFrame, slices: int = SLICES) -> DataFrame:
    """Ids (`conn_id`) of the connections that get their `username`.

    `named` has `_from` and `_to`, in microseconds, for each connection.
    """
    judged = greedy_intervals(
        named, F.col("username"), F.col("_from"), F.col("_to"), F.col("conn_id"), slices
    )
    return judged.filter("taken").select(F.col("id").alias("conn_id"), F.lit(True).alias("_in"))


def with_admission(checked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Add `admitted`, and the error of connections whose name is taken."""
    admitted = F.coalesce("_in", F.lit(False))
    taken = ~admitted & F.col("username").isNotNull()
    return (
        checked.join(chosen, "conn_id", "left")
        .withColumn("admitted", admitted)
        .withColumn("error", F.coalesce("error", F.when(taken, TAKEN_USERNAME)))
        .drop("_in")
    )


def admit(conns: DataFrame, slices: int = SLICES, checked: DataFrame | None = None) -> DataFrame:
    """Add `username`, `admitted` and `error`.

    A name is refused while another admitted connection holds it. Connections
    are taken in order of (`open_ts`, `conn_id`); a holder frees its name at
    `close_ts`; a refused connection never holds one, nor does one without a name,
    which is not admitted and has no error. The first frames are read several times;
    `checked` may give what `check_join` makes of the connections, stored beforehand.
    """
    checked = check_join(conns) if checked is None else checked
    named = checked.filter(F.col("username").isNotNull()).select(
        "conn_id",
        "username",
        micros(F.col("open_ts")).alias("_from"),
        micros(F.col("close_ts")).alias("_to"),
    )
    return with_admission(checked, chosen_holders(named, slices)).select(
        *conns.columns, "username", "admitted", "error"
    )


def presence_changes(admissions: DataFrame) -> DataFrame:
    """One row per user-list broadcast: each admission and each close.

    A refused connection is closed when it is refused; one without a name does not
    join, but its close is told.
    """
    closed = F.when(F.col("error").isNull(), F.col("close_ts")).otherwise(F.col("open_ts"))
    events = F.array(
        F.struct(F.lit("join").alias("kind"), F.col("open_ts").alias("ts")),
        F.struct(F.lit("close").alias("kind"), closed.alias("ts")),
    )
    kept = F.filter(events, lambda e: F.col("admitted") | (e["kind"] == "close"))
    return admissions.select("conn_id", F.explode(kept).alias("e")).select("conn_id", "e.kind", "e.ts")


def _holders(admissions: DataFrame) -> DataFrame:
    return admissions.filter("admitted").select(
        F.col("conn_id").alias("user_conn"), "username", "open_ts", "close_ts"
    )


def open_connections(admissions: DataFrame) -> DataFrame:
    """Connections that get messages while they are open: all that are not refused."""
    return admissions.filter(F.col("error").isNull()).select(
        F.col("conn_id").alias("recipient_conn"), "open_ts", "close_ts"
    )


def user_lists(
    changes: DataFrame, holders: DataFrame, bucket_seconds: int = 3600
) -> DataFrame:
    """User list, in connection order, and its size at each change.

    A holder counts from `seen_from` until `seen_to`. The list of a change is
    put together in the task that pairs it with the holders; what leaves that
    task is one row per change.
    """
    pairs = stab(changes, holders, "ts", "seen_from", "seen_to", "left", bucket_seconds)
    member = F.when(F.col("username").isNotNull(), F.struct("open_ts", "user_conn", "username"))
    lists = pairs.groupBy("_bucket", "_salt", "conn_id", "kind", "ts").agg(
        F.sort_array(F.collect_list(member)).alias("_members")
    )
    return lists.select(
        "ts",
        "conn_id",
        "kind",
        F.transform("_members", lambda m: m["username"]).alias("users"),
        F.size("_members").alias("online"),
    )


def seen_holders(admissions: DataFrame) -> DataFrame:
    """Holders of names for `user_lists`, seen from open to close."""
    return _holders(admissions).select(
        "user_conn",
        "username",
        "open_ts",
        F.col("open_ts").alias("seen_from"),
        F.col("close_ts").alias("seen_to"),
    )


def presence(admissions: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """User list and its size after each admission and each close."""
    return user_lists(presence_changes(admissions), seen_holders(admissions), bucket_seconds)


def presence_log(admissions: DataFrame, size: int = PAGE_ROWS) -> DataFrame:
    """What happened to the user list: (page, ts, kind, conn_id, username, since).

    A page starts with one row of kind `online` for each name held before its first
    instant, then come its joins and closes, about `size` in all. So the log grows
    with the changes as long as `size` is not much below the number of people online,
    and any list follows from one page (`lists_of_log`). `since` is when the name was taken;
    closes of connections that held none have no name.
    """
    named = admissions.filter("admitted").select(
        "conn_id", "username", F.col("open_ts").alias("since")
    )
    changes = in_pages(presence_changes(admissions), "ts", size)
    told = lookup_join(changes, named, ["conn_id"])
    starts = changes.groupBy("page").agg(F.min("ts").alias("start"))
    # Held just before an instant: opened before it, and not closed before it.
    tick = F.expr("INTERVAL 1 MICROSECOND")
    held = _holders(admissions).filter("open_ts < close_ts").select(
        "user_conn",
        "username",
        F.col("open_ts").alias("since"),
        (F.col("open_ts") + tick).alias("held_from"),
        (F.col("close_ts") + tick).alias("held_to"),
    )
    frames = stab(starts, held, "start", "held_from", "held_to").select(
        "page",
        F.col("start").alias("ts"),
        F.lit("online").alias("kind"),
        F.col("user_conn").alias("conn_id"),
        "username",
        "since",
    )
    return told.select("page", "ts", "kind", "conn_id", "username", "since").unionByName(frames)


def lists_of_log(log: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """User list and its size after each change in the log, or after those `wanted`
    (page, ts, conn_id, kind).

    A list needs the rows of its page only, whose number is bounded, so pages are spread
    evenly whatever share of the changes a name or a day has.
    """
    if wanted is None:
        wanted = log.filter("kind <> 'online'").select("page", "ts", "conn_id", "kind")
    # One row per name of a page: from its join, or the page's start, to its close.
    spans = (
        log.filter(F.col("username").isNotNull())
        .groupBy("page", "conn_id")
        .agg(
            F.max(F.when(F.col("kind") == "join", F.col("ts"))).alias("joined"),
            F.max(F.when(F.col("kind") == "close", F.col("ts"))).alias("closed"),
            F.first("username").alias("username"),
            F.first("since").alias("since"),
        )
        .withColumnRenamed("conn_id", "user_conn")
    )
    there = F.expr(
        "c.page = s.page AND (s.joined IS NULL OR s.joined <= c.ts)"
        " AND (s.closed IS NULL OR c.ts < s.closed)"
    )
    pairs = wanted.alias("c").join(spans.alias("s"), there, "left")
    member = F.when(F.col("s.username").isNotNull(), F.struct("s.since", "s.user_conn", "s.username"))
    lists = pairs.groupBy("c.page", "c.ts", "c.conn_id", "c.kind").agg(
        F.sort_array(F.collect_list(member)).alias("_members")
    )
    return lists.select(
        "ts",
        "conn_id",
        "kind",
        F.transform("_members", lambda m: m["username"]).alias("users"),
        F.size("_members").alias("online"),
    )


def online_counts(admissions: DataFrame) -> DataFrame:
    """Number of users online from each instant at which it may change."""
    counts = open_counts(_holders(admissions), "open_ts", "close_ts")
    return counts.select("ts", F.col("total").alias("online"))


def frame_rules(frame: Column) -> Column:
    """Status (accepted, ignored, error) and message of a later frame.

    The message is accepted whatever its JSON type, if it counts as true:
    not missing, null, false, 0 or empty. Text is given as it is, other types
    as JSON, an object in which a key stands twice as it was sent.
    """

    def truthy(message: Column) -> Column:
        kind = F.schema_of_variant(message)
        return (
            F.when(message.isNull() | (kind == "VOID"), False)
            .when(kind == "STRING", F.try_variant_get(message, "$", "string") != "")
            .when(kind == "BOOLEAN", F.try_variant_get(message, "$", "boolean"))
            .when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), True)
            .otherwise(F.try_variant_get(message, "$", "double") != 0)
        )

    def outcome(status: str, message: Column) -> Column:
        return F.struct(F.lit(status), message.cast("string"))

    def judge(document: Column) -> Column:
        is_message = _text(_field(document, "type")) == "message"
        accepted = _bound(
            _field(document, "message"),
            lambda m: F.when(
                truthy(m), outcome("accepted", F.coalesce(_text(m), F.to_json(m)))
            ).otherwise(outcome("ignored", F.lit(None))),
        )
        raw = _raw(frame)
        told = (raw["type"] == "message") & raw["message"].isNotNull() & ~raw["message"].isin(_FALSE)
        rewritten = (
            F.when(raw.isNull(), outcome("error", F.lit(BAD_FRAME)))
            .when(told, outcome("accepted", raw["message"]))
            .otherwise(outcome("ignored", F.lit(None)))
        )
        return (
            F.when(document.isNull(), rewritten)
            .when(_unreadable(document), outcome("error", F.lit(BAD_FRAME)))
            .when(is_message, accepted)
            .otherwise(outcome("ignored", F.lit(None)))
        )

    return _bound(_parsed(frame), judge).cast("struct<status:string,message:string>")


def check_frame(frames: DataFrame) -> DataFrame:
    """Add `status` and `message` to each later frame."""
    return frames.select("*", frame_rules(F.col("frame")).alias("_f")).select(
        *frames.columns, "_f.status", "_f.message"
    )


def sent_messages(frames: DataFrame, admissions: DataFrame) -> DataFrame:
    """Accepted frames sent by an admitted connection while it is open.

    Frames meet the connections first, so that only those of an open one are parsed.
    """
    senders = admissions.filter("admitted").select(
        "conn_id", "username", "open_ts", "close_ts", F.col("admitted").alias("_open")
    )
    sent = lookup_join(
        frames.select("frame_id", "conn_id", "ts", "frame"),
        senders,
        ["conn_id"],
        "inner",
        where="d.open_ts <= f.ts AND f.ts < d.close_ts",
    )
    # Both sides have a part in what is judged, else Spark would judge below the join.
    judged = sent.select("*", frame_rules(F.when(F.col("_open"), F.col("frame"))).alias("_f"))
    return judged.filter("_f.status = 'accepted'").select(
        "frame_id", "conn_id", "ts", "username", "_f.message", "frame"
    )


def fan_out(
    frames: DataFrame, admissions: DataFrame, bucket_seconds: int = 3600
) -> DataFrame:
    """One row per message and connection that gets it (the sender's too).

    The result has as many rows as messages were delivered; `delivery_counts` has one
    per message.
    """
    recipients = open_connections(admissions)
    sent = sent_messages(frames, admissions).select("frame_id", "ts")
    pairs = stab(
        sent, recipients, "ts", "open_ts", "close_ts", "inner", bucket_seconds, times=frames
    )
    return pairs.select("frame_id", "recipient_conn")


def delivery_counts(frames: DataFrame, admissions: DataFrame) -> DataFrame:
    """Number of recipients per message, without making the pairs."""
    sent = sent_messages(frames, admissions).select("frame_id", "ts")
    return count_open(
        sent, "ts", open_connections(admissions), "open_ts", "close_ts", "recipients", times=frames
    ).select("frame_id", "recipients")


def fan_out_versions(frames: DataFrame, admissions: DataFrame) -> DataFrame:
    """Who gets which message, in as many rows as there are messages and changes.

    (kind, id, version): each instant at which the recipients change begins the next
    version. A message names the version it is sent to; a connection gets the messages
    from the version of its `open` on and before that of its `close`. Version 0 has
    no recipients.
    """
    real = open_connections(admissions).filter("open_ts < close_ts")
    steps = F.array(
        F.struct(F.lit("open").alias("kind"), F.col("open_ts").alias("ts")),
        F.struct(F.lit("close").alias("kind"), F.col("close_ts").alias("ts")),
    )
    changes = real.select(F.col("recipient_conn").alias("id"), F.explode(steps).alias("_s")).select(
        "_s.kind", "id", "_s.ts"
    )
    sent = sent_messages(frames, admissions).select(
        F.lit("message").alias("kind"), F.col("frame_id").alias("id"), "ts"
    )
    # The version at a time is the number of instants up to it, as if each stayed open.
    instants = changes.select(F.col("ts").alias("begun")).distinct()
    instants = instants.withColumn("ended", F.lit(END_OF_TIME).cast("timestamp_ntz"))
    times = frames.select("ts").unionByName(changes.select("ts"))
    placed = count_open(
        sent.unionByName(changes), "ts", instants, "begun", "ended", "version", times=times
    )
    return placed.select("kind", "id", "version")
