"""Packing by vector bin packing: documents or examples go into training sequences
under simultaneous limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, small_batches, table, text_or_empty, worker_cache

END_ID = 2
#: Bytes that kept words may take in a Python worker, in each of two generations, and what
#: one takes besides its letters and ids.
CACHED_BYTES, WORD_BYTES = 200_000_000, 180
#: Marks that may follow a word.
MARKS = ".,;:!?%$#&*()\""
#: Rows, and bytes of them, whose words are learnt and kept at a time.
ROWS_AT_ONCE, BYTES_AT_ONCE = 100, 1_000_000
#: Sequence ids are the task's number shifted by so many bits, plus a running number.
TASK_SHIFT = 36

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how many cut-off ends wait for a place."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096
    waiting: int = 1024


class WordEncoder:
    """Token ids of whole texts, with the ids of words kept for the next text.

    The tokenizer folds white space, and no token spans it, so a text's ids are
    those of its white-space-separated words in a row. Texts with the separators
    that `str.split` takes for white space and the tokenizer does not go through
    the tokenizer whole.

    New words of letters are encoded many at a time: each ends with the one of its
    ids that stands for the end of a word. Marks after such a word are encoded apart
    from it, as the tokenizer takes them, if the word is of letters in lower case too (the
    lower case of some capitals ends in a combining mark, which would join them). All
    else is encoded word by word.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, tokenizer_json: str, cached_bytes: int = CACHED_BYTES):
        self.cached_bytes = cached_bytes
        cache = worker_cache("packing")
        if cache.get("json") != hash(tokenizer_json):
            from tokenizers import Tokenizer

            tool = Tokenizer.from_str(tokenizer_json)
            ends = np.zeros(tool.get_vocab_size(), bool)
            for piece, k in tool.get_vocab(with_added_tokens=False).items():
                ends[k] = piece.endswith("</w>")
            cache.clear()
            cache.update(json=hash(tokenizer_json), tool=tool, ends=ends)
            cache.update(words={}, older={}, bytes=0)
        self.cache, self.tool, self.ends = cache, cache["tool"], cache["ends"]

    def _encoded(self, text: str) -> bytes:
        return np.array(
            self.tool.encode(text, add_special_tokens=False).ids, dtype="<u4"
        ).tobytes()

    def _learn(self, words: set[str]) -> None:
        """Add the ids of words that are not known to those that are."""
        older = self.cache["older"]
        found = {w: older[w] for w in words & older.keys()}
        new = words - found.keys()
        plain = {w for w in new if w.isalpha()}
        marked, rest = [], []
        for w in new - plain:
            stem = w.rstrip(MARKS)
            (marked if stem.lower().isalpha() else rest).append((w, stem))
        known = self.cache["words"]
        stems = {stem for _, stem in marked if stem not in known}
        ids = self._together(list(plain | stems))
        after: dict[str, bytes] = {}
        for w, stem in marked:
            mark = w[len(stem) :]
            if mark not in after:
                after[mark] = self._encoded(mark)
            ids[w] = (ids.get(stem) or known[stem]) + after[mark]
        for w, _ in rest:
            ids[w] = self._encoded(w)
        ids |= found
        known.update(ids)
        self.cache["bytes"] += sum(WORD_BYTES + len(w) + len(own) for w, own in ids.items())

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, many at a time; each word ends with an end-of-word id."""
        out: dict[str, bytes] = {}
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            joined = self.tool.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(joined[0].ids, dtype="<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(part):
                flat = ids.tobytes()
                out.update(zip(part, [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)], strict=True))
            else:
                out.update({w: self._encoded(w) for w in part})
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cache = self.cache
        if cache["bytes"] > self.cached_bytes:
            cache.update(older=cache["words"], words={}, bytes=0)
        split = [None if any(c in t for c in self.ODD) else t.split() for t in texts]
        self._learn(set().union(*[w for w in split if w]).difference(cache["words"]))
        get = cache["words"].__getitem__
        return [
            self._encoded(t) if w is None else b"".join(map(get, w))
            for t, w in zip(texts, split, strict=True)
        ]


class Packer:
    """Fills one sequence after another from the pieces that wait.

    A piece of a whole sequence's length goes out at once. Of the others, the one
    with the largest dot product of its size (tokens, segments, loss-bearing
    tokens) and the room left is placed until none fits; then the best of the rest
    is cut to fill the sequence.
    """

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.full = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.size = np.zeros((0, 3))
        self.items: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes, prompt: int) -> None:
        """A document's ids; the first `prompt` of them bear no loss."""
        total, at, step = len(ids) // 4, 0, self.limits.tokens
        while total - at >= step and self._loss(prompt, at, step) <= self.limits.loss:
            self._emit([(doc_id, ids, at, step, total, prompt)])
            at += step
        if at < total:
            self._wait([(doc_id, ids, at, total - at, total, prompt)])
        while len(self.items) >= 2 * self.limits.waiting:
            self._fill()

    def finish(self) -> None:
        """Place all that waits; the last sequences get lengths that are powers of two."""
        while self.items and self.size[:, 0].sum() >= self.limits.tokens:
            self._fill()
        while self.items:
            rest = int(self.size[:, 0].sum())
            self._fill(min(self.limits.tokens, 1 << (rest.bit_length() - 1)))

    @staticmethod
    def _loss(prompt: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, prompt))

    def _wait(self, items: list[tuple]) -> None:
        self.items += items
        sizes = [[i[3], 1, self._loss(i[5], i[2], i[3])] for i in items]
        self.size = np.concatenate([self.size, np.array(sizes, dtype=float).reshape(-1, 3)])

    def _take(self, k: int) -> tuple:
        """Remove a waiting piece; the last one takes its place."""
        item, last = self.items[k], self.items.pop()
        if k < len(self.items):
            self.items[k], self.size[k] = last, self.size[-1]
        self.size = self.size[:-1]
        return item

    def _fill(self, tokens: int | None = None) -> None:
        """One sequence of `tokens` ids, or as near to it as the limits allow."""
        room = self.full.copy()
        room[0] = tokens or self.limits.tokens
        placed: list[tuple] = []
        while self.items and room[0] > 0 and room[1] > 0:
            score = (self.size / self.full) @ (room / self.full)
            fits = (self.size <= room).all(axis=1)
            if fits.any():
                item = self._take(int(np.where(fits, score, -1.0).argmax()))
            else:
                item = self._take(int(score.argmax()))
                head = self._head(item, int(room[0]), int(room[2]))
                if not head:
                    self._wait([item])
                    break
                doc_id, ids, start, length, total, prompt = item
                self._wait([(doc_id, ids, start + head, length - head, total, prompt)])
                item = (doc_id, ids, start, head, total, prompt)
            placed.append(item)
            room -= (item[3], 1, self._loss(item[5], item[2], item[3]))
        self._emit(placed)

    @staticmethod
    def _head(item: tuple, tokens: int, loss: int) -> int:
        """How many leading ids of a piece fit."""
        free = max(0, item[5] - item[2])  # ids of the prompt, which bear no loss
        return min(item[3], tokens, free + loss)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, ids, start, length, total, prompt in pieces:
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            loss = self._loss(prompt, start, length)
            self.out.append((doc_id, start, length, crc, total, self.next_id, offset, loss))
            offset += length
        self.next_id += bool(pieces)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_partition(
    batches: Iterable[pa.RecordBatch],
    tokenizer_json: str,
    limits: Limits,
    first_id: int,
    cached_bytes: int = CACHED_BYTES,
) -> Iterator[pa.RecordBatch]:
    """The pieces of one partition's rows (doc_id, text, prompt)."""
    kinds = [(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")]
    schema = pa.schema(kinds)
    encoder, packer = WordEncoder(tokenizer_json, cached_bytes), Packer(limits, first_id)
    end = struct.pack("<I", END_ID)

    def ready() -> pa.RecordBatch:
        rows = packer.rows()
        return column_batch(schema, list(zip(*rows, strict=True)) if rows else [[]] * len(kinds))

    for batch in small_batches(iter(batches), ROWS_AT_ONCE, BYTES_AT_ONCE):
        ids, texts, prompts = (batch.column(k).to_pylist() for k in range(3))
        for doc_id, found, prompt in zip(ids, encoder.encode(texts), prompts, strict=True):
            packer.add(doc_id, found + end, prompt)
        yield ready()
    packer.finish()
    yield ready()


def public_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    limits: Limits | None = None,
    prompt_column: str | None = None,
    cached_bytes: int = CACHED_BYTES,
) -> DataFrame:
    """Pieces of documents (doc_id, text) laid out in sequences of `limits.tokens` ids.

    Each row's text becomes ids (no special ones added) and then id 2. Every id is
    in exactly one piece; a sequence is filled without gaps. `prompt_column` names
    a count of leading ids that bear no loss (none without it). Rows are packed in
    the partition they lie in, with at most twice `limits.waiting` cut-off ends in
    memory and `cached_bytes` (twice) of words' ids, so nothing is shuffled; the tokenizer (a file of fixed size, read by
    the driver) goes out with the job. At the end of a partition the rest is cut
    into sequences whose lengths are powers of two, which need no padding.

    A null or empty text has the end id alone. A null doc_id stays null. Repeated
    rows are packed each on its own. Other columns are ignored. An empty table
    gives no rows. Where the segment or loss limit is reached first, a sequence is
    shorter than `limits.tokens`.
    """
    limits = limits or Limits()
    if min(limits.tokens, limits.segments, limits.loss, limits.waiting) < 1:
        raise ValueError("each limit must be at least 1")
    tool = docs.sparkSession.sparkContext.broadcast(public_tokenizer(tokenizer_path))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << TASK_SHIFT
        yield from pack_partition(batches, tool.value, limits, first, cached_bytes)

    prompt = F.coalesce(F.col(prompt_column), F.lit(0)) if prompt_column else F.lit(0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_or_empty().alias("text"),
        prompt.cast("long").alias("prompt"),
    ).mapInArrow(packed, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
