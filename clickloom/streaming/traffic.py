"""Rate limits and first-writer rules on live requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.functions.rules import micros
from clickloom.operators.traffic import MAX_HITS, WINDOW_SECONDS, window_counts
from clickloom.streaming.ordered import WindowCounter, in_order
from clickloom.streaming.runner import Lookup, now, per_batch


def stream_rate_limit(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    key: str = "ip",
    ts: str = "ts",
    window_seconds: int = WINDOW_SECONDS,
    **options,
) -> StreamingQuery:
    """Hits per key and clock-aligned window, a row for each micro-batch that has some.

    `latest_windows` adds them up. No state is kept between batches, so a hit counts
    however late it comes; hits of one task are counted before the shuffle.
    """

    def count(rows: DataFrame, batch_id: int) -> DataFrame:
        return window_counts(rows, key, ts, window_seconds).drop("limited_hits")

    return per_batch(requests, out, checkpoint, "append", count, **options)


def latest_windows(written: DataFrame, key: str = "ip", max_hits: int = MAX_HITS) -> DataFrame:
    """Hits and limited hits of each window so far."""
    return written.groupBy(key, "window_start").agg(
        F.sum("hits").alias("hits"),
        F.greatest(F.sum("hits") - max_hits, F.lit(0)).alias("limited_hits"),
    )


def stream_rate_limit_anchored(
    requests: DataFrame,
    out: str,
    checkpoint: str,
    key: str = "ip",
    ts: str = "ts",
    order: str = "request_id",
    window_seconds: int = WINDOW_SECONDS,
    max_hits: int = MAX_HITS,
    delay: str = "1 minute",
    **options,
) -> StreamingQuery:
    """Write (`order`, `key`, limited) of each hit, with windows that open at a key's first hit.

    Hits may come up to `delay` late, in any order; they are judged once the watermark
    has passed them. The state of a key is its waiting hits and the count of its
    open window, which a timer removes when the window ends.
    """
    judged = in_order(
        requests, F.col(key), micros(F.col(ts)), F.lit(0), F.col(order), delay,
        WindowCounter(window_seconds * 1_000_000, max_hits),
    ).withColumnsRenamed({"_id": order, "_key": key})
    return per_batch(judged, out, checkpoint, "append", **options)


def stream_first_writer(
    requests: DataFrame,
    key: str,
    taken: Lookup,
    out: str,
    checkpoint: str,
    ask: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> StreamingQuery:
    """The request that gets each free name or code: the lowest `request_id`.

    `ask` gives the askers (request_id and `key`) of a micro-batch of requests; it may
    join tables in any way. Ids grow in order of arrival, so a later micro-batch cannot
    take a name over. The minimum comes first: a name that everybody asks for is one
    row when it meets those that are taken.
    """

    def winners(rows: DataFrame, batch_id: int) -> DataFrame:
        asked = ask(rows) if ask else rows
        first = (
            asked.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.min("request_id").alias("request_id"))
        )
        return first.join(now(taken).select(key), key, "left_anti")

    return per_batch(requests, out, checkpoint, "append", winners, **options)


def first_writers(written: DataFrame, key: str) -> DataFrame:
    return written.groupBy(key).agg(F.min("request_id").alias("request_id"))
