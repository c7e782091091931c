"""Repair of conversation structure by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, stored, table

#: A piece of a conversation holds at most so many different rows and characters of text.
PIECE_ROWS = 2000
PIECE_CHARS = 4_000_000

# States of the role pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ENDS = (START, ASSISTANT)
KEEP = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
#: Where a user or assistant row that is free to choose leads from each state.
FREE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE_COST, REROLE_COST, INSERT_COST = 3, 2, 2
LEGAL = ("su", "ua", "au")
FAR = 1 << 60
WHITE = " \t\n\x0b\f\r"

Row = tuple[str | None, bool, bool, int]  # role initial, must go, truncated, how often


def edits(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """Letters, cost and next state of each edit of a row."""
    initial, must_go, truncated, times = row
    yield "D" * times, DELETE_COST * times, state
    if not must_go:
        if (kept := KEEP.get(initial, {}).get(state)) is not None:
            yield "K", int(truncated), kept
        yield "R", REROLE_COST + truncated, FREE[state]


def suffix_bounds(rows: list[Row], ends: Iterable[int]) -> list[list[int]]:
    """For each place and state, a cost that no completion to one of `ends` can beat.

    The relaxed problem leaves the audits aside; one pass from the back solves it.
    """
    bounds = [[FAR] * 4 for _ in range(len(rows) + 1)]
    for state in ends:
        bounds[-1][state] = 0
    for at in range(len(rows), -1, -1):
        here = bounds[at]
        if at < len(rows):
            after = bounds[at + 1]
            for state in STATES:
                here[state] = min(cost + after[to] for _, cost, to in edits(rows[at], state))
        for _ in STATES:  # inserted rows lead on without a row of the conversation
            for state in STATES:
                here[state] = min(here[state], INSERT_COST + here[FREE[state]])
    return bounds


def search(rows: list[Row], entry: int = START, ends: Iterable[int] = ENDS) -> tuple[int, str] | None:
    """The cheapest (cost, audit) that leads from a state to one of `ends`, ties ASCII-least.

    Depth first with an explicit stack, the most promising edit on top. A prefix is
    dropped if its cost and suffix bound exceed the incumbent's cost, if they equal it
    and its letters already come later, or if its node (place and state) was reached by
    a better prefix. Prefixes that reach a node at equal cost are never the start of one
    another, as only inserted rows could tell them apart and those cost; so the first
    letter that differs decides, whatever follows. None if there is no way.
    """
    ends = tuple(ends)
    bounds = suffix_bounds(rows, ends)
    reached: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(len(rows) + 1)]
    incumbent: tuple[int, str] | None = None
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        bound = cost + bounds[at][state]
        if bound >= FAR:
            continue
        if incumbent and (bound, audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        best = reached[at][state]
        if best is not None and best <= (cost, audit):
            continue
        reached[at][state] = cost, audit
        if at == len(rows) and state in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = cost, audit
        steps = [("I", INSERT_COST, FREE[state], at)]
        if at < len(rows):
            steps += [(*step, at + 1) for step in edits(rows[at], state)]
        ranked = sorted(
            ((cost + c + bounds[to_at][to], letters, to_at, to, cost + c) for letters, c, to, to_at in steps),
            reverse=True,
        )
        stack += [(to_at, to, c, audit + letters) for _, letters, to_at, to, c in ranked]
    return incumbent


def compose(tables: list[dict[tuple[int, int], tuple[int, str]]]) -> list[tuple[int, int]]:
    """Entry and exit state of each piece on the best way through all of them.

    A table has the best (cost, audit) of a piece for each entry and exit. Of the
    audits so far only what lies after their common start is kept for comparison.
    """
    ways: dict[int, tuple[int, str, tuple | None]] = {START: (0, "", None)}
    for found in tables:
        after: dict[int, tuple[int, str, tuple | None]] = {}
        for (entry, leave), (cost, audit) in found.items():
            if entry in ways:
                before, letters, path = ways[entry]
                way = (before + cost, letters + audit, (path, entry, leave))
                if leave not in after or way[:2] < after[leave][:2]:
                    after[leave] = way
        common = len(os.path.commonprefix([w[1] for w in after.values()]))
        ways = {s: (c, letters[common:], path) for s, (c, letters, path) in after.items()}
    path = min((ways[s] for s in ENDS if s in ways), key=lambda w: w[:2])[2]
    steps = []
    while path:
        path, entry, leave = path
        steps.append((entry, leave))
    return steps[::-1]


def repaired(
    rows: list[Row], messages: list[tuple[str, str]], audit: str, state: int
) -> list[tuple[str, str]]:
    """The messages that the edits of an audit make of the given ones."""
    out, letters = [], iter(audit)
    for row, (role, text) in zip(rows, messages, strict=True):
        left = 0
        while left < (row[3] if row[1] else 1):
            letter = next(letters)
            if letter == "I":
                state = FREE[state]
                out.append((ROLE[state], ""))
                continue
            left += 1
            if letter == "K":
                state = KEEP[row[0]][state]
                out.append((role, text))
            elif letter == "R":
                state = FREE[state]
                out.append((ROLE[state], text))
    for _ in letters:
        state = FREE[state]
        out.append((ROLE[state], ""))
    return out


@dataclass
class Piece:
    """Consecutive rows of a conversation: turn, role, text, times, first (of its kind)."""

    turns: list[int | None] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    times: list[int] = field(default_factory=list)
    firsts: list[bool] = field(default_factory=list)
    blanks: list[bool] = field(default_factory=list)
    cuts: list[bool] = field(default_factory=list)

    def columns(self) -> list[list]:
        return [self.turns, self.roles, self.texts, self.times, self.firsts, self.blanks, self.cuts]

    def steps(self) -> tuple[list[Row], list[tuple[str, str]]]:
        """Rows for the search with their messages; a row that stands once more comes apart."""
        rows, messages = [], []
        lines = zip(*self.columns(), strict=True)
        for _, role, text, times, first, blank, cut in lines:
            stays = not blank and first and times > 0
            if stays:
                rows.append((role[:1], False, cut, 1))
                messages.append((role, text))
            if times > stays:
                rows.append((role[:1], True, False, times - stays))
                messages.append((role, text))
        return rows, messages

    def counts(self) -> dict:
        """What is counted in a piece, and its first and last turn and role for its neighbours."""
        out = dict(blank=0, duplicate=0, truncated=0, illegal=0, n_turns=0)
        out |= dict(least=None, most=None, head=None, tail=None)
        for turn, role, _, times, first, blank, cut in zip(*self.columns(), strict=True):
            if not times:
                continue
            if blank:
                out["blank"] += times
            else:
                out["duplicate"] += times - first
                out["truncated"] += first and cut
            out["illegal"] += times - 1 + (
                out["tail"] is not None and out["tail"] + role[:1] not in LEGAL
            )
            out["head"] = role[:1] if out["head"] is None else out["head"]
            out["tail"] = role[:1]
            if turn is not None:
                out["n_turns"] += turn != out["most"]
                out["least"] = turn if out["least"] is None else out["least"]
                out["most"] = turn
        return out


TEXTS = pa.list_(pa.string())
PIECES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_())]
    + [("turns", pa.list_(pa.int64())), ("roles", TEXTS), ("texts", TEXTS)]
    + [("times", pa.list_(pa.int64()))]
    + [(name, pa.list_(pa.bool_())) for name in ("firsts", "blanks", "cuts")]
)
PIECES_DDL = (
    "conv_id long, part int, piece int, whole boolean, turns array<long>, roles array<string>, "
    "texts array<string>, times array<long>, firsts array<boolean>, blanks array<boolean>, cuts array<boolean>"
)
DONE = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64())]
    + [(name, pa.int64()) for name in ("least", "most", "n_turns")]
    + [(name, pa.int64()) for name in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
    + [("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
)
DONE_DDL = (
    "conv_id long, seq long, least long, most long, n_turns long, blank long, duplicate long, "
    "truncated long, illegal long, cost long, audit string, repaired array<struct<role string, text string>>"
)
TABLES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32())]
    + [("least", pa.int64()), ("most", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
    + [("entries", pa.list_(pa.int8())), ("leaves", pa.list_(pa.int8()))]
    + [("costs", pa.list_(pa.int64())), ("audits", TEXTS)]
)
TABLES_DDL = (
    "conv_id long, part int, piece int, least long, most long, head string, tail string, "
    "entries array<tinyint>, leaves array<tinyint>, costs array<long>, audits array<string>"
)
WAYS = pa.schema(
    [("part", pa.int32()), ("piece", pa.int32()), ("seq", pa.int64())]
    + [("entry", pa.int8()), ("leave", pa.int8()), ("same_turn", pa.int64()), ("joint", pa.int64())]
)
WAYS_DDL = "part int, piece int, seq long, entry tinyint, leave tinyint, same_turn long, joint long"
ROWS_AT_ONCE = 256


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return column_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * len(schema))


def cut_pieces(batches: Iterable[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the conversations of one part, whose rows come in order.

    A piece is whole if its conversation neither touches an end of the part, beyond
    which it may go on, nor is too long for one piece.
    """
    piece, conv, chars, number, closed, ready = Piece(), None, 0, 0, False, []
    begun = opened = False

    def close(whole: bool) -> None:
        nonlocal piece, chars, number
        ready.append((conv, part, number, whole, *piece.columns()))
        piece, chars, number = Piece(), 0, number + 1

    for batch in batches:
        for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if begun and conv_id != conv:
                close(whole=opened and not closed)
                opened, closed = True, False
            elif len(piece.turns) >= PIECE_ROWS or chars >= PIECE_CHARS:
                close(whole=False)
                closed = True
            begun, conv = True, conv_id
            for column, value in zip(piece.columns(), row, strict=True):
                column.append(value)
            chars += len(row[2])
            if len(ready) >= ROWS_AT_ONCE:
                yield _batch(PIECES, ready)
                ready.clear()
    if begun:
        close(whole=False)
    yield _batch(PIECES, ready)


def _pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, Piece]]:
    for row in batch.to_pylist():
        own = [row.pop(f) for f in ("turns", "roles", "texts", "times", "firsts", "blanks", "cuts")]
        yield row, Piece(*own)


def _finish(row: dict, piece: Piece, entry: int, ends: Iterable[int], seq: int) -> tuple:
    rows, messages = piece.steps()
    cost, audit = search(rows, entry, ends)
    made = [dict(role=r, text=t) for r, t in repaired(rows, messages, audit, entry)]
    seen = piece.counts()
    return (
        row["conv_id"], seq, seen["least"], seen["most"], seen["n_turns"] - row.get("same_turn", 0),
        seen["blank"], seen["duplicate"], seen["truncated"], seen["illegal"] + row.get("joint", 0),
        cost, audit, made,
    )


def solve_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired piece of each conversation that is one piece."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield _batch(DONE, [_finish(r, p, START, ENDS, 0) for r, p in _pieces_of(part)])


def solve_tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best (cost, audit) of each piece for each pair of states that it can join."""
    for batch in batches:
        out = []
        for row, piece in _pieces_of(batch):
            rows, _ = piece.steps()
            ways = [(e, x, search(rows, e, [x])) for e in STATES for x in STATES]
            ways = [(e, x, *found) for e, x, found in ways if found]
            seen = piece.counts()
            ends = [seen[k] for k in ("least", "most", "head", "tail")]
            out.append((row["conv_id"], row["part"], row["piece"], *ends, *map(list, zip(*ways, strict=True))))
        yield _batch(TABLES, out)


def join_pieces(found: pa.Table) -> pa.Table:
    """For each piece of one conversation its place, its states and what counts at its joint."""
    rows = sorted(found.to_pylist(), key=lambda r: (r["part"], r["piece"]))
    ways = compose(
        [
            {
                (e, x): (c, a)
                for e, x, c, a in zip(r["entries"], r["leaves"], r["costs"], r["audits"], strict=True)
            }
            for r in rows
        ]
    )
    out, turn, tail = [], None, None
    for seq, (row, (entry, leave)) in enumerate(zip(rows, ways, strict=True)):
        same = int(turn is not None and row["least"] == turn)
        joint = int(tail is not None and row["head"] is not None and tail + row["head"] not in LEGAL)
        out.append((row["part"], row["piece"], seq, entry, leave, same, joint))
        turn = turn if row["most"] is None else row["most"]
        tail = tail if row["tail"] is None else row["tail"]
    return pa.Table.from_batches([_batch(WAYS, out)])


def finish_split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch(
            DONE,
            [_finish(r, p, r["entry"], [r["leave"]], r["seq"]) for r, p in _pieces_of(batch)],
        )


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) with known faults, for tests of a repair.

    The remainder of crc32(`conv_id:turn`) by 20 says what happens to a row: 0 drops it
    (times 0), 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it (times
    2), 4 makes its role user. A null counts as one space, in the key too.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = space("text")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.translate(text, ".!?", ""))
        .otherwise(text)
        .alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def _marked(rows: DataFrame) -> DataFrame:
    """Different rows with how often they stand, whether they are the first of their
    role and text, blank, or cut off."""
    grouped = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    message = F.concat_ws(":", F.char_length("role").cast("string"), "role", "text")
    keyed = grouped.withColumn("kind", F.sha2(message, 256))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = (
        keyed.where("times > 0")
        .groupBy("conv_id", "kind")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first"))
        .where("rows > 1")
        .select(F.col("conv_id").alias("c"), F.col("kind").alias("k"), "first")
    )
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("kind") == F.col("k"))
    first = F.col("first").isNull() | F.col("turn").eqNullSafe(F.col("first.turn"))
    solid = F.rtrim(F.col("text"), F.lit(WHITE))
    return keyed.join(again, on, "left").select(
        "conv_id", "turn", "role", "text", "times",
        first.alias("first"),
        (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("cut"),
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired conversations of rows (conv_id, turn, role, text, times), as two tables:
    those in one piece, and the pieces of all others, in the order of seq.

    Columns are conv_id, seq, least, most and n_turns (of the turns), blank, duplicate,
    truncated, illegal, cost, audit and repaired (role and text of each message).

    Rows stand by turn, nulls first, then by role and text. A row's first fault counts:
    blank (nothing but white space), duplicate (role and text stood before in the
    conversation), truncated (the last character that is no white space is not `.`, `!`
    or `?`). Edits keep a row (K, cost 0), make its role user or assistant (R, 2), delete
    it (D, 3; a must for blank and duplicate rows) or insert a message without text (I,
    2); a truncated row that stays costs 1 more. The roles' initials must end as
    `(s?(ua)+)?`; of the cheapest audits the ASCII-least is taken, proved by `search`.

    Rows are dealt by ranges of (conv_id, turn, role, text), equal ones counted before, so
    a conversation of any length is spread over tasks, in pieces of bounded size. A piece
    that is a whole conversation is solved at once; of the others each gives the best
    audit for each pair of states it can join, and the best way through the pieces
    of a conversation is composed of those tables (without texts). What is one string in
    the result, the audit, is as long as its conversation.

    A null role or text must be filled in before (`damage` does). A null conv_id is a
    conversation of its own. Rows with times 0 are no part of their conversation, but
    name it: it comes out without messages. Repeated rows are duplicates. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    order = ["conv_id", "turn", "role", "text"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = _marked(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut_pieces(batches, TaskContext.get().partitionId())

    pieces = stored(ranged.mapInArrow(cut, PIECES_DDL), "conversation-pieces")
    split = pieces.where("not whole").drop("whole")
    ways = (
        split.mapInArrow(solve_tables, TABLES_DDL)
        .groupBy("conv_id")
        .applyInArrow(join_pieces, WAYS_DDL)
    )
    whole = pieces.where("whole").mapInArrow(solve_whole, DONE_DDL)
    several = split.join(ways, ["part", "piece"]).mapInArrow(finish_split, DONE_DDL)
    return whole, stored(several, "conversation-splits")


def _digests(pieces: DataFrame) -> DataFrame:
    """conv_id, seq 0 and sha256 of each conversation's messages, read piece by piece in order."""
    schema = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None  # conv_id, digest so far, whether it has a message
        for batch in batches:
            out = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or state[0] != conv:
                    out += [(state[0], state[1].hexdigest())] if state else []
                    state = conv, hashlib.sha256(), False
                if text is not None:
                    state[1].update((("\n" if state[2] else "") + text).encode("utf-8", "surrogatepass"))
                    state = conv, state[1], True
            yield _batch(schema, out)
        yield _batch(schema, [(state[0], state[1].hexdigest())] if state else [])

    lines = pieces.select("conv_id", "seq", F.when(F.size("repaired") > 0, _joined()).alias("text"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "text").mapInArrow(run, "conv_id long, sha string")


def _joined() -> Column:
    return F.array_join(
        F.transform("repaired", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n"
    )


def summary(whole: DataFrame, several: DataFrame) -> DataFrame:
    """One row per conversation that `repair` returns: gaps, counts, cost, audit and the digest of its messages.

    A conversation in several pieces is read through in one task for its digest, as the
    hash of one long text cannot be put together of parts; nothing of it is kept there.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    columns = ["conv_id", gaps, *counts, "audit", "repaired_sha256"]
    one = whole.withColumn("repaired_sha256", F.sha2(_joined(), 256))
    audits = F.array_sort(F.collect_list(F.struct("seq", "audit")))
    totals = several.groupBy("conv_id").agg(
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.sum("n_turns").alias("n_turns"),
        *[F.sum(c).alias(c) for c in counts],
        F.array_join(F.transform(audits, lambda a: a["audit"]), "").alias("audit"),
    )
    digests = _digests(several).select(F.col("conv_id").alias("c"), F.col("sha").alias("repaired_sha256"))
    joined = totals.join(digests, F.col("conv_id").eqNullSafe(F.col("c")))
    return one.select(*columns).union(joined.select(*columns))


def op11_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(*repair(damage(table(spark, sf_dir, "conversations"))))
