"""Rules that need events in order of time, on events that come out of order.

The state of a group of keys keeps their events until the watermark has passed their
instant; they are then handed over, key by key, in order. Events may so come in any order
within the allowed delay, and an instant may be split over several micro-batches. What is
kept per key is its events of that delay and one row. A group is read and written as a
whole and its rows come as Arrow, as a call or a row of state per event costs far more
than the event. What is decided leaves the group packed too, and is unpacked and stored
by all tasks, so that a key with most of the events costs its task little for each. Rows
that need no order pass a group by, so that a stream judges each of its rows once,
whatever becomes of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Keys are dealt to so many groups by their hash; a key's events stay in one group.
GROUPS = 256
#: Rows of the result that leave a group as one.
CHUNK_ROWS = 20_000

STATE = "waiting binary, kept binary"
ARROW_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
WAITING = pa.schema([("key", pa.string()), ("at", pa.int64()), ("rank", pa.int32()), ("id", pa.int64())])

Event = tuple[int, int, int]  # time in microseconds, place within an instant, id

# What a row is: it moves the clock only, is an event, needs no order, or that without an id.
CLOCK, EVENT, APART, NAMELESS = range(4)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in batch.column(0):
            yield from unpacked(rows.as_py()).to_batches()


def wake(state: GroupState, at: int) -> None:
    """Come back once the watermark has reached a time, in microseconds, that it has not reached."""
    state.setTimeoutTimestamp(max(-(-at // 1000) - 1, 1))


def _by_key(events: pa.Table) -> Iterator[tuple[str | None, list[Event]]]:
    """Each key with its events in order of (time, rank, id)."""
    code = events.column("key").combine_chunks().dictionary_encode("encode")
    keys, place = code.dictionary.to_pylist(), code.indices.to_numpy()
    at, rank, ids = (events.column(c).to_numpy() for c in ("at", "rank", "id"))
    order = np.lexsort((ids, rank, at, place))
    place = place[order]
    ordered = list(zip(at[order].tolist(), rank[order].tolist(), ids[order].tolist(), strict=True))
    bounds = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(ordered)]
    for first, last in zip(bounds, bounds[1:]):
        yield keys[place[first]], ordered[first:last]


class InOrder:
    """Hands a key's events to `decide` in order of (time, rank, id), once they are complete.

    Subclasses name the layout of the row kept per key (`KEPT`) and of the result.
    """

    KEPT = ""
    DDL = ""

    @property
    def result(self) -> pa.Schema:
        fields = [f.split() for f in self.DDL.split(", ")]
        return pa.schema([(name, ARROW_TYPES[kind]) for name, kind in fields])

    def decide(self, key: Any, kept: tuple | None, events: list[Event]) -> tuple[list[tuple], tuple | None]:
        """Rows of the result, and what is kept from now on (None: nothing)."""
        raise NotImplementedError

    def judge(self, events: pa.Table, kept: dict[str | None, tuple]) -> pd.DataFrame:
        """The result of a group's complete events; brings what is `kept` per key up to date."""
        out: list[tuple] = []
        for name, own in _by_key(events):
            found, now = self.decide(name, kept.pop(name, None), own)
            out += found
            if now is not None:
                kept[name] = now
        return pd.DataFrame(out, columns=self.result.names)

    def pass_by(self, ids: pd.Series, texts: pd.Series, ats: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        """The result of rows that need no order; their key's place holds any text."""
        raise NotImplementedError

    def until(self, kept: tuple) -> int | None:
        """Time after which what is kept no longer matters."""
        return None

    def advance(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Take a group's rows of a micro-batch, and decide what the watermark has passed."""
        passed = state.getCurrentWatermarkMs() * 1000
        waiting, kept = state.getOption or (None, None)
        tables = [unpacked(waiting) if waiting else WAITING.empty_table()]
        kept = self._kept(kept) if kept else {}
        for frame in rows:
            # By place: the group, the key, the event, what it is.
            what = frame.iloc[:, 5].to_numpy()
            apart = frame[what >= APART]
            if len(apart):
                ids = apart.iloc[:, 4].astype("Int64").where(apart.iloc[:, 5] == APART)
                yield self._out(self.pass_by(ids, apart.iloc[:, 1], apart.iloc[:, 2].astype("Int64"), apart.iloc[:, 3]))
            real = frame[what == EVENT]
            if len(real):
                columns = [real.iloc[:, k] for k in range(1, 5)]
                arrays = [pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, WAITING)]
                tables.append(pa.Table.from_arrays(arrays, schema=WAITING))
        events = pa.concat_tables(tables)
        ready = events.column("at").to_numpy() <= passed
        if ready.any():
            yield self._out(self.judge(events.filter(pa.array(ready)), kept))
            events = events.filter(pa.array(~ready))
        ends = {name: self.until(row) for name, row in kept.items()}
        kept = {n: row for n, row in kept.items() if ends[n] is None or ends[n] > passed}
        if not kept and not events.num_rows:
            if state.exists:
                state.remove()
            return
        state.update((packed(events) if events.num_rows else None, self._packed(kept) if kept else None))
        wakes = [ends[n] for n in kept if ends[n] is not None]
        if events.num_rows:
            wakes.append(int(events.column("at").to_numpy().min()))
        if wakes:
            wake(state, min(wakes))

    def _out(self, rows: pd.DataFrame) -> pd.DataFrame:
        table = pa.Table.from_pandas(rows, self.result, preserve_index=False)
        parts = range(0, table.num_rows, CHUNK_ROWS)
        return pd.DataFrame({"rows": [packed(table.slice(k, CHUNK_ROWS)) for k in parts]})

    def _kept(self, rows: bytes) -> dict[str | None, tuple]:
        columns = [c.to_pylist() for c in unpacked(rows).columns]
        return dict(zip(columns[0], zip(*columns[1:], strict=True), strict=True))

    def _packed(self, kept: dict[str | None, tuple]) -> bytes:
        names = [f.split()[0] for f in self.KEPT.split(", ")]
        schema = pa.schema([("key", pa.string()), *((n, pa.int64()) for n in names)])
        columns = [list(kept), *zip(*kept.values(), strict=True)]
        return packed(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def in_order(
    events: DataFrame, key: Column, at: Column, rank: Column, id_: Column, delay: str, rule: InOrder,
    groups: int = GROUPS, apart: Column | None = None,
) -> DataFrame:
    """What `rule` decides of each key's events, which may come `delay` late.

    `at` is a time in microseconds. Later events than that are left out and counted
    (`late_rows`). A row with a NULL id moves the clock and is nothing else: without
    further events, one such row lets what still waits be decided. Keys are dealt to
    `groups`, each of which is one task's work in a micro-batch. Rows `apart` need no order:
    `rule.pass_by` gets them, with any text as their key, at once and however late they
    come; they do not move the clock.
    """
    apart = F.lit(False) if apart is None else apart
    known = id_.isNotNull()
    event = known & at.isNotNull()
    keyed = events.select(
        F.pmod(F.xxhash64(F.when(apart, id_.cast("string")).otherwise(key.cast("string"))), F.lit(groups))
        .cast("int").alias("_group"),
        key.cast("string").alias("_key"),
        at.cast("long").alias("_at"),
        rank.cast("int").alias("_rank"),
        F.coalesce(id_.cast("long"), F.lit(0)).alias("_id"),
        F.when(apart, F.when(known, APART).otherwise(NAMELESS))
        .otherwise(F.when(event, EVENT).otherwise(CLOCK)).alias("_what"),
        F.when(~apart, F.timestamp_micros(at.cast("long"))).alias("_time"),
    )
    told = (
        keyed.withWatermark("_time", delay)
        .groupBy("_group")
        .applyInPandasWithState(rule.advance, "rows binary", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
    # With a column made here, as Spark cannot shuffle the rows that a state function gives as they are.
    parts = told.select("rows", F.length("rows").alias("size"))
    return parts.repartition(told.sparkSession.sparkContext.defaultParallelism).mapInArrow(_unpack, rule.DDL)


def late_rows(query) -> int:
    """Events that a stream left out, as they came after the allowed delay."""
    return sum(
        s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]
    )


class NameHolder(InOrder):
    """Who holds a name: one connection at a time, first come first served.

    Rank 0 is a close, 1 an open. At one instant a holder's close comes first, then opens
    in order of id; a connection that closes as it opens frees the name at once. Whom a
    holder's close lets in is known for each open beforehand, so only admissions are gone
    through one by one; refusals are what is left.

    Rows that pass by have no name: an open or close of a connection without one, or one
    refused for the text in the key's place, which is told once, at its open.
    """

    KEPT = "id long, since long"
    DDL = "_id long, _name string, _kind string, _at long, _since long, _error string"

    def decide(self, key, kept, events):
        columns = [[key] * len(events), *zip(*events, strict=True)]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WAITING)], schema=WAITING)
        held = {} if kept is None else {key: kept}
        found = self.judge(table, held).drop(columns="_error")
        return list(found.itertuples(index=False, name=None)), held.get(key)

    def judge(self, events, kept):
        code = events.column("key").combine_chunks().dictionary_encode("encode")
        names = np.array(code.dictionary.to_pylist(), object)
        # A holder from before stands in front of its name's events.
        held = [(place, *kept.pop(name)) for place, name in enumerate(names) if name in kept]
        holders = np.array(held, np.int64).reshape(-1, 3)
        count = len(holders)
        key = np.concatenate([holders[:, 0], code.indices.to_numpy()])
        at, rank, ids = (events.column(c).to_numpy() for c in ("at", "rank", "id"))
        at = np.concatenate([holders[:, 2], at])
        rank = np.concatenate([np.ones(count, np.int32), rank])
        ids = np.concatenate([holders[:, 1], ids])
        order = np.lexsort((ids, rank, at, np.arange(len(key)) >= count, key))
        key, at, opens, ids, old = key[order], at[order], rank[order] != 0, ids[order], order < count
        size = len(key)

        # The close that ends what an open begins, `size` without one, and whether it is at once.
        mine = np.lexsort((np.arange(size), ids, key))
        nth, ends = np.arange(size), ~opens[mine]
        following = np.minimum.accumulate(np.where(ends, nth, size)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(ends, nth, -1))
        same = lambda other: (key[mine] == key[mine[other]]) & (ids[mine] == ids[mine[other]])
        found = (following < size) & same(np.minimum(following, size - 1))
        at_once = (before >= 0) & same(before) & (at[mine] == at[mine[before]]) & ~old[mine]
        close, brief = np.empty(size, np.int64), np.empty(size, bool)
        close[mine] = np.where(found, mine[np.minimum(following, size - 1)], size)
        brief[mine] = at_once

        # From an admission to the next one.
        last = np.searchsorted(key, key, "right")
        free = np.where(brief, nth + 1, np.where(close < size, close + 1, last))
        coming = np.append(np.minimum.accumulate(np.where(opens, nth, size)[::-1])[::-1], size)
        step, admitted, now = coming[free], [], int(coming[0])
        while now < size:
            admitted.append(now)
            now = int(step[now])
        joined = np.zeros(size, bool)
        joined[admitted] = True

        stays = np.flatnonzero(joined & ~brief & (close == size))
        for name, who, since in zip(names[key[stays]], ids[stays].tolist(), at[stays].tolist(), strict=True):
            kept[name] = (who, since)
        told = np.flatnonzero(opens & ~old)
        gone = np.flatnonzero(joined & (brief | (close < size)))
        when = np.where(brief[gone], gone, close[gone])
        rows, times = np.concatenate([told, gone]), np.concatenate([told, when])
        since = np.concatenate([at[told], at[gone]])
        refused = np.concatenate([~joined[told], np.zeros(len(gone), bool)])
        kinds = np.array(["join", "close", "refused"], object)
        kind = np.where(refused, 2, np.arange(len(rows)) >= len(told))
        place = np.lexsort((kind == 1, times))
        columns = (
            ids[rows], names[key[rows]], kinds[kind], at[times], pd.arrays.IntegerArray(since, refused),
            np.full(len(rows), None, object),
        )
        return pd.DataFrame({n: c[place] for n, c in zip(self.result.names, columns, strict=True)})

    def pass_by(self, ids, texts, ats, ranks):
        kinds = np.where(texts.notna(), "refused", np.where(ranks == 1, "open", "close")).astype(object)
        told = (texts.isna() | (ranks == 1)).to_numpy()
        nothing = np.full(len(ids), None, object)
        since = pd.Series(pd.NA, ids.index, "Int64")
        columns = (ids, nothing, kinds, ats, since, texts)
        return pd.DataFrame(dict(zip(self.result.names, columns, strict=True)), index=ids.index)[told]


class WindowCounter(InOrder):
    """Flags a key's hits beyond a limit; a window opens at the first hit after the last one."""

    KEPT = "start long, seen long"
    DDL = "_id long, _key string, limited boolean"

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most

    def decide(self, key, kept, events):
        out = []
        for at, _, i in events:
            if kept is None or at >= kept[0] + self.width:
                kept = (at, 0)
            kept = (kept[0], kept[1] + 1)
            out.append((i, key, kept[1] > self.most))
        return out, kept

    def until(self, kept):
        return kept[0] + self.width
