"""Greedy choice of non-overlapping intervals per key, in parallel within a key.

Per key, take the first interval; then, again and again, the first later one
that starts at or after the end of the one taken last. A rate-limit window that
opens at the first hit, and a user name held by one connection at a time, are
both this choice.

The choice is sequential, and one key may hold a large share of the rows. So
the rows of a heavy key are cut into slices of about as many rows each (by its
quantiles of start), and each slice is first
reduced, in its own task, to the function "free from time c" -> "free again from
time d" (a short step table, as choices from different starting times soon
fall together). Tables of neighbouring slices are chained into one per block,
still in parallel; walking through the blocks, and then inside each, gives the
time each slice is free from, and every slice makes its choice on its own.
Light keys are one slice and skip these steps. The Python parts read sorted Arrow
batches as a stream and hold one batch and one step table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.plans.skew import heavy_keys, mark_heavy

ALWAYS_FREE = -(2**62)

# Slices of a heavy key. Their edges are at most so many numbers for each of the at
# most `clickloom.heavyKeys` heavy keys.
SLICES = 1024

# Slices whose step tables are chained into one before the walk over a key.
BLOCK_SLICES = 64

_TABLE = "grp string, slice long, upto long, free long"
_ENTRY = "grp string, slice long, free long"
_CHOICE = "grp string, start long, id long, taken boolean, until long"


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(group, slice) with the bounds of its rows, for rows sorted by them."""
    n = batch.num_rows
    if n == 0:
        return
    group, cut = batch.column("grp"), _numbers(batch, "slice")
    other = pc.not_equal(group.slice(1), group.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    changes = np.flatnonzero(other | (cut[1:] != cut[:-1])) + 1
    bounds = [0, *changes.tolist(), n]
    for first, last in zip(bounds, bounds[1:]):
        yield (group[first].as_py(), int(cut[first])), first, last


def _leaving_times(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each interval, when the key is free again if the choice begins with it."""
    n = len(starts)
    following = np.maximum(np.searchsorted(starts, ends, "left"), np.arange(1, n + 1)).tolist()
    leaving = ends.tolist()
    for i in range(n - 1, -1, -1):
        if following[i] < n:
            leaving[i] = leaving[following[i]]
    return np.array(leaving, dtype=np.int64)


def _through(table: tuple[np.ndarray, np.ndarray], free: np.ndarray) -> np.ndarray:
    """Apply a step table; times after its last entry pass unchanged."""
    upto, out = table
    at = np.searchsorted(upto, free, "left")
    return np.where(at < len(upto), out[np.minimum(at, len(upto) - 1)], free)


def _composed(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Chain the step tables that follow each other under one key into one table."""
    current, upto, out = None, None, None

    def rows():
        n = len(upto)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(current[0]), n), np.full(n, current[1]), pa.array(upto), pa.array(out)],
            names=["grp", "slice", "upto", "free"],
        )

    for key, part in parts:
        if key != current:
            if current is not None:
                yield rows()
            current, (upto, out) = key, part
        else:
            upto = np.concatenate([upto, part[0]])
            out = np.concatenate([_through(part, out), part[1]])
        keep = np.append(out[1:] != out[:-1], True)
        upto, out = upto[keep], out[keep]
    if current is not None:
        yield rows()


def _step_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce each (group, slice) of sorted intervals to its step table."""

    def parts():
        for batch in batches:
            starts, ends = _numbers(batch, "start"), _numbers(batch, "end")
            for key, first, last in _runs(batch):
                part = starts[first:last]
                yield key, (part, _leaving_times(part, ends[first:last]))

    return _composed(parts())


def _block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain the step tables of the slices of each block, given in slice order."""

    def parts():
        for batch in batches:
            upto, out = _numbers(batch, "upto"), _numbers(batch, "free")
            for (group, cut), first, last in _runs(batch):
                yield (group, cut // BLOCK_SLICES), (upto[first:last], out[first:last])

    return _composed(parts())


def _entry_times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the step tables of each (group, block) in slice order from its `entry` time."""
    current, block, free, after = None, None, ALWAYS_FREE, None
    for batch in batches:
        upto, out = _numbers(batch, "upto"), _numbers(batch, "free")
        blocks, entry = _numbers(batch, "block"), _numbers(batch, "entry")
        groups, slices, times = [], [], []
        for key, first, last in _runs(batch):
            if key != current:
                here = key[0], int(blocks[first])
                if here != block:
                    block, free = here, int(entry[first])
                elif after is not None:
                    free = after
                current, after = key, None
                groups.append(key[0])
                slices.append(key[1])
                times.append(free)
            if after is None:
                at = first + int(np.searchsorted(upto[first:last], free, "left"))
                if at < last:
                    after = int(out[at])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(groups, pa.string()),
                pa.array(slices, pa.int64()),
                pa.array(times, pa.int64()),
            ],
            names=["grp", "slice", "free"],
        )


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the intervals each (group, slice) takes, and until when it is taken at each row.

    Rows that are not `real` (an entry time) come first in
    their slice, take part, and are left out of the result.
    """
    current, free = None, ALWAYS_FREE
    for batch in batches:
        starts, ends = _numbers(batch, "start"), _numbers(batch, "end")
        start_list, end_list = starts.tolist(), ends.tolist()
        taken = np.zeros(batch.num_rows, dtype=bool)
        until = np.empty(batch.num_rows, dtype=np.int64)
        for key, first, last in _runs(batch):
            if key != current:
                current, free = key, ALWAYS_FREE
            begun, at = first, bisect_left(start_list, free, first, last)
            while at < last:
                until[begun:at] = free
                taken[at] = True
                begun, free = at, end_list[at]
                at = bisect_left(start_list, free, at + 1, last)
            until[begun:last] = free
        marked = pa.RecordBatch.from_arrays(
            [batch.column("grp"), batch.column("start"), batch.column("id"), pa.array(taken), pa.array(until)],
            names=["grp", "start", "id", "taken", "until"],
        )
        yield marked.filter(batch.column("real"))


def _slice_entries(tables: DataFrame) -> DataFrame:
    """The time each slice is free from, by its step table: (grp, slice, free).

    Blocks of slices are chained in parallel, the walk over a whole key sees one
    short table per block, and the walks inside the blocks run in parallel again.
    """
    block = F.floor(F.col("slice") / F.lit(BLOCK_SLICES)).cast("long")
    placed = tables.withColumn("block", block).repartition("grp", "block")
    order = ["grp", "block", "slice", "upto"]
    heads = (
        placed.sortWithinPartitions(*order)
        .mapInArrow(_block_tables, _TABLE)
        .select("*", F.lit(0).cast("long").alias("block"), F.lit(ALWAYS_FREE).alias("entry"))
        .repartition("grp")
        .sortWithinPartitions(*order)
        .mapInArrow(_entry_times, _ENTRY)
        .select("grp", F.col("slice").alias("block"), F.col("free").alias("entry"))
    )
    return (
        placed.join(heads, ["grp", "block"], "left")
        .sortWithinPartitions(*order)
        .mapInArrow(_entry_times, _ENTRY)
    )


def _edges(rows: DataFrame, slices: int) -> DataFrame:
    """Starts at which slices 1, 2, ... of each heavy key begin: (grp, _edges)."""
    places = [k / slices for k in range(1, slices)]
    if not places:
        return rows.select("grp", F.array().cast("array<long>").alias("_edges")).distinct()
    quantiles = F.percentile_approx("start", places, 10 * slices)
    return rows.groupBy("grp").agg(F.array_distinct(quantiles).alias("_edges"))


def _slice_of(start: Column, edges: Column, slices: int) -> Column:
    """How many of the sorted edges are not after `start`, by halving."""
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(slices.bit_length() + 1)),
        F.struct(F.lit(0).alias("low"), F.size(edges).alias("high")),
        lambda at, _: F.when(at["low"] >= at["high"], at).otherwise(
            F.when(
                F.get(edges, F.shiftright(at["low"] + at["high"], 1)) <= start,
                F.struct(
                    (F.shiftright(at["low"] + at["high"], 1) + 1).alias("low"), at["high"].alias("high")
                ),
            ).otherwise(
                F.struct(at["low"].alias("low"), F.shiftright(at["low"] + at["high"], 1).alias("high"))
            )
        ),
        lambda at: at["low"],
    )
    return F.when(edges.isNull(), 0).otherwise(halved).cast("long")


def greedy_intervals(
    df: DataFrame,
    key: Column,
    start: Column,
    end: Column,
    order: Column,
    slices: int = SLICES,
) -> DataFrame:
    """Each interval as (grp, start, id, taken, until), times in microseconds.

    `taken` marks the chosen ones; `until` is the end of the interval that holds
    the key when this one starts. `order` is a unique integer that breaks ties of
    `start`; `start` and `end` are microseconds and not NULL; a missing key counts
    as an empty one.
    """
    rows = df.select(
        F.coalesce(key.cast("string"), F.lit("")).alias("grp"),
        start.alias("start"),
        end.alias("end"),
        order.cast("long").alias("id"),
        F.lit(True).alias("real"),
    )
    heavy = heavy_keys(rows, ["grp"])
    edges = _edges(rows.join(F.broadcast(heavy), "grp", "left_semi"), slices)
    rows = (
        mark_heavy(rows, heavy, ["grp"])
        .join(F.broadcast(edges), "grp", "left")
        .withColumn("slice", _slice_of(F.col("start"), F.col("_edges"), slices))
    )
    tables = (
        rows.filter("_salts IS NOT NULL")
        .select("grp", "slice", "start", "end", "real", "id")
        .repartition("grp", "slice")
        .sortWithinPartitions("grp", "slice", "start", "real", "id")
        .mapInArrow(_step_tables, _TABLE)
    )
    columns = ["grp", "slice", "start", "end", "id", "real"]
    entries = _slice_entries(tables).select(
        "grp",
        "slice",
        F.lit(ALWAYS_FREE).alias("start"),
        F.col("free").alias("end"),
        F.lit(0).cast("long").alias("id"),
        F.lit(False).alias("real"),
    )
    return (
        rows.select(*columns)
        .unionByName(entries)
        .repartition("grp", "slice")
        .sortWithinPartitions("grp", "slice", "start", "real", "id")
        .mapInArrow(_choose, _CHOICE)
    )
