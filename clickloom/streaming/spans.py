"""Points that meet the spans they lie in, on live events.

The state of a group of keys holds its points and spans. They are matched as they come, a
group's rows of a micro-batch at once; a group is read and written as a whole, as a row of
state per point costs far more than the point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickloom.streaming.ordered import GROUPS, packed, unpacked, wake

# What a row is: it moves the clock only, is a point, a point without a key, or a span.
CLOCK, POINT, KEYLESS, SPAN = range(4)

POINTS = pa.schema(
    [("key", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("until", pa.int64()), ("text", pa.string()),
     ("met", pa.bool_())]
)
SPANS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def _pairs(points: pa.Table, spans: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of points and spans that meet: `start <= at < end <= until`, of one key."""
    keyed = points.column("key").is_valid().to_numpy()
    keys = points.column("key").fill_null(0).to_numpy()
    order = np.argsort(spans.column("key").to_numpy(), kind="stable")
    sorted_keys = spans.column("key").to_numpy()[order]
    low = np.searchsorted(sorted_keys, keys, "left")
    many = np.where(keyed, np.searchsorted(sorted_keys, keys, "right") - low, 0)
    point = np.repeat(np.arange(len(keys)), many)
    nth = np.arange(len(point)) - np.repeat(np.cumsum(many) - many, many)
    span = order[np.repeat(low, many) + nth]
    at, until = (points.column(c).to_numpy()[point] for c in ("at", "until"))
    start, end = (spans.column(c).to_numpy()[span] for c in ("start", "end"))
    inside = (start <= at) & (at < end) & (end <= until)
    return point[inside], span[inside]


RESULT = "_id long, _key long, _at long, _text string, _found string"
STATE = "points binary, spans binary"


def _told(points: pa.Table, found: pa.Array | pa.ChunkedArray) -> pd.DataFrame:
    """Rows of the result."""
    keys = pd.array(points.column("key").to_pandas(integer_object_nulls=True), dtype="Int64")
    columns = (
        points.column("id").to_numpy(), keys, points.column("at").to_numpy(), points.column("text").to_pandas(),
        pd.Series(found.to_numpy(zero_copy_only=False), dtype=object),
    )
    return pd.DataFrame(dict(zip((f.split()[0] for f in RESULT.split(", ")), columns, strict=True)))


def match(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Each point of a group with the text of each span it meets, or alone once its time is up.

    A point waits until the watermark has passed `until`, and a span until it has passed
    `end`, as no point within it can come then.
    """
    passed = state.getCurrentWatermarkMs() * 1000
    held = state.getOption or (None, None)
    points, spans = ([unpacked(h) if h else s.empty_table()] for h, s in zip(held, (POINTS, SPANS)))
    old_points, old_spans = points[0].num_rows, spans[0].num_rows
    for frame in rows:
        # By place: the group, what it is, id, key, two times, text.
        what = frame.iloc[:, 1].to_numpy()
        point = frame[(what == POINT) | (what == KEYLESS)]
        if len(point):
            keys = pa.array(point.iloc[:, 3], pa.int64(), mask=point.iloc[:, 1].to_numpy() == KEYLESS)
            rest = [pa.array(point.iloc[:, k], f.type, from_pandas=True) for k, f in zip((2, 4, 5, 6), list(POINTS)[1:5])]
            met = pa.array(np.zeros(len(point), bool))
            points.append(pa.Table.from_arrays([keys, *rest, met], schema=POINTS))
        span = frame[what == SPAN]
        if len(span):
            columns = [pa.array(span.iloc[:, k], f.type, from_pandas=True) for k, f in zip((3, 4, 5, 6), SPANS)]
            spans.append(pa.Table.from_arrays(columns, schema=SPANS))
    points, spans = pa.concat_tables(points).combine_chunks(), pa.concat_tables(spans).combine_chunks()
    point, span = _pairs(points, spans)
    # What was held before has met already.
    fresh = (point >= old_points) | (span >= old_spans)
    point, span = point[fresh], span[fresh]
    met = points.column("met").to_numpy().copy()
    met[point] = True
    if len(point):
        yield _told(points.take(pa.array(point)), spans.column("text").take(pa.array(span)))
    due = points.column("until").to_numpy() <= passed
    alone = np.flatnonzero(due & ~met)
    if len(alone):
        yield _told(points.take(pa.array(alone)), pa.nulls(len(alone), pa.string()))
    points = points.set_column(5, POINTS.field("met"), pa.array(met)).filter(pa.array(~due))
    spans = spans.filter(pa.array(spans.column("end").to_numpy() > passed))
    wakes = [t.column(c).to_numpy().min() for t, c in ((points, "until"), (spans, "end")) if t.num_rows]
    if wakes:
        state.update(tuple(packed(t) if t.num_rows else None for t in (points, spans)))
        wake(state, int(min(wakes)))
    elif state.exists:
        state.remove()


def points_in_spans(
    points: DataFrame, spans: DataFrame, delay: str, groups: int = GROUPS
) -> DataFrame:
    """Points (`id`, `key`, `at`, `until`, `text`) with the `text` of each span (`key`, `start`,
    `end`, `text`) of their key with `start <= at < end <= until`, or with none: (_id, _key, _at,
    _text, _found). Keys and ids are longs, times timestamps.

    Both are streams whose rows come up to `delay` late, by `at` and by `end`; later ones
    are left out. A point meets a span once both are there; one that no span has met
    comes out alone when `until` has passed. Points without an id, and spans without a key
    or length, only move the clock. A group of keys is one task's work in a micro-batch.
    """
    none = lambda kind: F.lit(None).cast(kind)
    long = lambda c: F.coalesce(c.cast("long"), F.lit(0))

    def row(what, id_, key, begin, end, text, time):
        return (
            F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("_group"), what.alias("_what"),
            long(id_).alias("_id"), long(key).alias("_key"), long(F.unix_micros(begin)).alias("_begin"),
            long(F.unix_micros(end)).alias("_end"), text.alias("_text"), time.alias("_time"),
        )

    id_, key, at, until = (F.col(c) for c in ("id", "key", "at", "until"))
    real = id_.isNotNull() & at.isNotNull()
    what = F.when(real, F.when(key.isNotNull(), POINT).otherwise(KEYLESS)).otherwise(CLOCK)
    left = points.select(*row(what, id_, key, at, until, F.col("text"), at)).withWatermark("_time", delay)
    start, end = F.col("start"), F.col("end")
    what = F.when(key.isNotNull() & (start < end), SPAN).otherwise(CLOCK)
    right = spans.select(*row(what, none("long"), key, start, end, F.col("text"), end)).withWatermark("_time", delay)
    groups = left.unionByName(right).groupBy("_group")
    return groups.applyInPandasWithState(match, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
