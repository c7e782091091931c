"""Clicks, running totals and unlocks on live events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.clicks import apply_unlocks, build_clicks, unlock_outcomes
from clickloom.sources.snapshots import Snapshot
from clickloom.streaming.runner import Lookup, batch_folder, now, per_batch


def stream_clicks(
    hits: DataFrame, links: Lookup, geo: Lookup, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Resolve, enrich and append each hit on a known code.

    A micro-batch goes through the batch operator, which spreads a busy code. Links
    and places are looked up as they are at the time of the batch.
    """

    def resolve(rows: DataFrame, batch_id: int) -> DataFrame:
        return build_clicks(rows, now(links), now(geo))

    return per_batch(hits, out, checkpoint, "append", resolve, **options)


def stream_click_totals(clicks: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Running clicks per code; each micro-batch writes the codes it touched."""
    totals = clicks.groupBy("shorturl").agg(F.count(F.lit(1)).alias("clicks"))
    return per_batch(totals, out, checkpoint, "update", **options)


def latest_totals(written: DataFrame) -> DataFrame:
    """The last count per code: counts only grow."""
    return written.groupBy("shorturl").agg(F.max("clicks").alias("clicks"))


def stream_unlocks(
    attempts: DataFrame, links: Lookup, clicks: Lookup, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the outcome of each unlock attempt.

    The clicks themselves are not rewritten for every micro-batch: the outcomes
    are a small log, and `current_clicks` merges it when the clicks are read. Links
    and clicks are looked up as they are at the time of the batch.
    """

    def judge(rows: DataFrame, batch_id: int) -> DataFrame:
        return unlock_outcomes(rows, now(links), now(clicks))

    return per_batch(attempts, out, checkpoint, "append", judge, **options)


def current_clicks(clicks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Clicks with the status after all unlocks logged so far."""
    return apply_unlocks(clicks, outcomes)


def stream_unlocks_into(
    attempts: DataFrame, links: Lookup, clicks: Snapshot, out: str, checkpoint: str, **options
) -> StreamingQuery:
    """Append the outcome of each unlock attempt and keep the clicks themselves up to date.

    `clicks` has a version 0. A micro-batch reads the id ranges of the clicks it tries
    and rewrites those with a click it opens, as a version of its own; a batch that is run
    again starts from the version before it. `stream_unlocks` is the cheaper form where
    the clicks tried lie all over the table.
    """

    def judge(rows: DataFrame, batch_id: int) -> DataFrame:
        version = batch_id + 1
        folder = batch_folder(f"{checkpoint}/judged", batch_id)
        tried = clicks.read(rows.select("click_id"), before=version)
        judged = unlock_outcomes(rows, now(links), tried)
        # Judged once: the log and the clicks follow from the same rows.
        judged.write.mode("overwrite").parquet(folder)
        outcomes = rows.sparkSession.read.schema(judged.schema).parquet(folder)
        opened = outcomes.filter("status = 200").select("click_id")
        clicks.write(apply_unlocks(clicks.read(opened, before=version), outcomes), version)
        return outcomes

    return per_batch(attempts, out, checkpoint, "append", judge, **options)
