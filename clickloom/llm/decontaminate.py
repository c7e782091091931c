"""Benchmark decontamination with a generalised suffix automaton of test items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, small_batches, table, text_or_empty

WINDOW = 10
#: Words of one automaton. A larger benchmark is dealt to several automata, one after another.
AUTOMATON_WORDS = 100_000
ROWS_AT_ONCE = 500

#: Bytes that are part of a word, once A-Z are lower case: digits, a-z, all beyond ASCII.
_WORD_BYTES = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
SEPARATED = bytes(b if b in _WORD_BYTES else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(SEPARATED).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the word numbers of all items.

    `step` follows a text word by word and keeps the length of the longest suffix
    read so far that occurs in an item.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[int]] = [set()]
        self.names: list[str] = []
        #: Items of fewer words than a window, by their words.
        self.whole: dict[tuple[int, ...], set[int]] = {}
        number_of: dict[str, int] = {}
        self.shortest = window
        for name, words in items:
            if not words:
                continue
            if name not in number_of:
                number_of[name] = len(self.names)
                self.names.append(name)
            item, at = number_of[name], 0
            for w in words:
                at = self._append(at, self.number.setdefault(w, len(self.number)))
                self.ends[at].add(item)
            if len(words) < window:
                self.shortest = min(self.shortest, len(words))
                self.whole.setdefault(tuple(self.number[w] for w in words), set()).add(item)
        self._settle()

    def _append(self, last: int, c: int) -> int:
        """The state after one more word; states of earlier items are used again."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for its shorter words, which p reaches by word c."""
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _settle(self) -> None:
        """Items of each state, and for each state what a match that ends in it hits."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.length[self.link[s]] >= self.window:
                self.ends[self.link[s]] |= self.ends[s]
        #: Items that hold the `window` words at the end of a match in this state.
        self.at_window: list[frozenset[int]] = [frozenset()] * len(self.next)
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.at_window[s] = (
                    self.at_window[up]
                    if self.length[up] >= self.window
                    else frozenset(self.ends[s])
                )
        #: Lengths of whole short items that end a match in this state: (length, items).
        self.at_short: list[tuple] = [()] * len(self.next)
        found: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for words, items in self.whole.items():
            s = 0
            for w in words:
                s = self.next[s][w]
            found.setdefault(s, []).append((len(words), frozenset(items)))
        for s in order:
            self.at_short[s] = (*self.at_short[self.link[s]], *found.get(s, ()))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int, bool]], set[int]]:
        """Spans of words (start, end) that are hit, in order and apart, and the items.

        A span is marked if it holds the whole of an item shorter than a window.
        """
        get = self.number.get
        numbers = [get(w, -1) for w in words]
        spans: list[tuple[int, int, bool]] = []
        items: set[int] = set()
        at, n = 0, len(numbers)
        while at < n:
            if numbers[at] < 0:
                at += 1
                continue
            try:
                end = numbers.index(-1, at)
            except ValueError:
                end = n
            if end - at >= self.shortest:
                self._run(numbers, at, end, spans, items)
            at = end
        return spans, items

    def _run(self, numbers, begin, end, spans, items) -> None:
        """Follow a run of known words."""
        state, length, window = 0, 0, self.window
        step, link, longest = self.next, self.link, self.length
        for i in range(begin, end):
            c = numbers[i]
            while state and c not in step[state]:
                state = link[state]
                length = longest[state]
            to = step[state].get(c)
            if to is None:
                continue
            state, length = to, length + 1
            start, short = None, False
            if length >= window:
                items |= self.at_window[state]
                start = i + 1 - length
            else:
                for size, whole in self.at_short[state]:
                    if size <= length:
                        items |= whole
                        short = True
                        start = i + 1 - size if start is None else min(start, i + 1 - size)
            if length >= window and self.at_short[state]:
                short = True
                for size, whole in self.at_short[state]:
                    items |= whole
            if start is not None:
                while spans and spans[-1][1] >= start:
                    first, _, had = spans.pop()
                    start, short = min(start, first), short or had
                spans.append((start, i + 1, short))


def _merged(spans: Iterable[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    out: list[tuple[int, int, bool]] = []
    for start, end, short in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), short or out[-1][2])
        else:
            out.append((start, end, short))
    return out


@dataclass(frozen=True)
class CutRule:
    """What is cut from a training document.

    A hit span goes if it has at least `min_words` words, or if it holds the whole of an
    item shorter than a window. A document goes whole if hit words are more than
    `max_coverage` of its words.
    """

    min_words: int = WINDOW
    max_coverage: float = 0.8


def cut(text: str, spans: list[tuple], rule: CutRule) -> str | None:
    """The text without its hit spans (start, end, and the mark, if any); None if too much is hit."""
    places = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    hit = sum(end - start for start, end, *_ in spans)
    if hit > rule.max_coverage * len(places):
        return None
    out, at = [], 0
    for start, end, *short in spans:
        if end - start >= rule.min_words or any(short):
            out.append(text[at : places[start][0]].rstrip())
            at = places[end - 1][1]
    return "".join([*out, text[at:]]) if out else text


def _automata(benchmark: DataFrame, window: int) -> Iterator[SuffixAutomaton]:
    """Automata of at most AUTOMATON_WORDS words each (a longer item has its own)."""
    items, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), text_or_empty()).toLocalIterator()
    for name, text in rows:
        words = words_of(text)
        if items and size + len(words) > AUTOMATON_WORDS:
            yield SuffixAutomaton(items, window)
            items, size = [], 0
        items.append(("" if name is None else name, words))
        size += len(words)
    yield SuffixAutomaton(items, window)


def _judged(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int,
    finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """docs, whose second column is the text, with n_words, spans and item_ids at the end.

    `finish` may turn these rows back into rows of docs. All passes and it run in one
    Python worker: nodes in a row would each take a worker of their own per core, and
    workers live on into the stages that follow.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    out = docs.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<struct<start:int,end:int,short:boolean>>").alias("spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    context = docs.sparkSession.sparkContext
    steps = [_pass(context.broadcast(automaton)) for automaton in _automata(benchmark, window)]
    steps += [finish] if finish else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        yield from batches

    return out.mapInArrow(run, docs.schema if finish else out.schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document (doc_id, text) with its words, hit spans of words and hit items.

    Columns: doc_id, text, n_words, spans (start, end of words, short: holds a whole
    item of fewer words than a window), item_ids.
    Documents stream through the automaton; nothing is shuffled. The benchmark, a
    table made by hand, is read by the driver part by part; each automaton has a
    bounded number of words, and a larger benchmark takes several passes over the
    stream, in one job.

    Null or empty texts have no words and no hits; items without words hit nothing;
    repeated documents are judged each on its own; a null item_id counts as the
    empty name, and rows of the same item_id as one item. Empty tables give no
    documents, or documents without hits. Other columns are ignored.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return _judged(plain, benchmark, window)


def _pass(shared):
    """One automaton's hits, added to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in small_batches(batches, ROWS_AT_ONCE):
            *others, _, before, names = batch.columns
            counts, spans, items = [], [], []
            had_spans, had_items = before.to_pylist(), names.to_pylist()
            for k, text in enumerate(others[1].to_pylist()):
                words = words_of(text) if text else []
                found, hit = automaton.hits(words)
                if had_spans[k]:
                    found = _merged([*found, *((s["start"], s["end"], s["short"]) for s in had_spans[k])])
                counts.append(len(words))
                spans.append([{"start": a, "end": b, "short": c} for a, b, c in found])
                items.append(sorted({automaton.names[i] for i in hit} | set(had_items[k])))
            yield column_batch(batch.schema, [*others, counts, spans, items])

    return run


def leak_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find_leaks(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rule: CutRule | None = None
) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) without their hit spans.

    A document goes whole if more of it is hit than `rule.max_coverage`; one without
    hits stays as it is, null or not. Columns beyond these five are not returned.
    """
    rule = rule or CutRule(min_words=window)
    plain = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))

    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            columns = batch.columns[:5]
            texts, sizes = columns[1].to_pylist(), columns[4].to_pylist()
            stay = []
            for k, spans in enumerate(batch.column(6).to_pylist()):
                hit = [(s["start"], s["end"], s["short"]) for s in spans]
                if hit and (left := cut(texts[k], hit, rule)) != texts[k]:
                    if left is None:
                        continue
                    texts[k], sizes[k] = left, len(left)
                stay.append(k)
            columns[1], columns[4] = pa.array(texts, columns[1].type), pa.array(sizes, pa.int64())
            made = pa.RecordBatch.from_arrays(columns, names=names)
            yield made if len(stay) == len(texts) else made.take(pa.array(stay, pa.int64()))

    return _judged(plain, benchmark, window, run)


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP9_SQL = f"""
WITH docs AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_SQL_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, w[k:k + n - 1] AS win
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS k
        FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, k, n, w[k:k + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)
), found AS (SELECT p.doc_id, p.k, p.n, i.item_id FROM places p JOIN windows i ON p.win = i.win),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.names, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""
