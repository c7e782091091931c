"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, few_rows, kept, small_batches, table, worker_cache

UNDETERMINED = "und"
HELD_OUT = 5
#: Labelled documents the model is fitted on: about so many of each language.
SAMPLE_DOCUMENTS = 300
#: Rounds of expectation and maximisation.
ROUNDS = 2
#: Longest piece used, in characters, and the mark of a word's beginning.
LONGEST = 8
MARK = "▁"
#: At most 4096 words of so many characters are worked on together, of longer ones fewer.
WIDTH = 48
#: Sums are scaled after so many characters: a piece or character has 1e-8 or more, about.
STRETCH = 16
#: Words whose scores a Python worker keeps.
CACHED_WORDS = 250_000
ROWS_AT_ONCE = 500
#: Probability left to each character that no piece covers, and counts added to a piece.
UNSEEN = 1e-7
ADDED = 0.02

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")


def public_pieces(path: str) -> list[str]:
    """Pieces of the public vocabulary, of LONGEST characters at most, without control pieces."""
    import sentencepiece

    tool = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = lambda k: tool.is_control(k) or tool.is_unknown(k) or tool.is_byte(k)
    pieces = {tool.id_to_piece(k).lower() for k in range(tool.get_piece_size()) if not skip(k)}
    return sorted(p for p in pieces if 0 < len(p) <= LONGEST)


class Lattice:
    """All segmentations of words into pieces, for many words at a time.

    A piece is found by a hash of its characters; a character that no piece covers
    is a piece of its own, of fixed small probability.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        hashes = np.array([self._hash_one(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    @staticmethod
    def _hash_one(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & (2**64 - 1)
        return h

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Characters of words (rows), zero beyond their ends."""
        width = max(map(len, words))
        flat = "".join([w.ljust(width, "\0") for w in words])
        return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Piece (or -1) of each word (rows) that begins at a place and has a length (1 first)."""
        n, width = codes.shape
        out = np.full((n, width, LONGEST), -1, np.int32)
        values = codes.astype(np.uint64) + np.uint64(1)
        there = codes > 0
        rolling = np.zeros((n, width), np.uint64)
        for k in range(min(LONGEST, width)):
            m = width - k
            rolling = rolling[:, :m] * _BASE + values[:, k:]
            place = np.searchsorted(self.hashes, rolling)
            place[place == len(self.hashes)] = 0
            found = (self.hashes[place] == rolling) & there[:, k:]
            out[:, :m, k] = np.where(found, self.order[place], -1)
        return out

    def forward(
        self, codes: np.ndarray, ids: np.ndarray, probs: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sums over the segmentations of each word's first 1, 2, ... characters.

        Each is given as values and the logs of their scales (both words by languages):
        every STRETCH characters the values are scaled to one, so that no word is too
        long. `probs` has one row per piece and a last one for characters without a piece.
        """
        n, width = codes.shape
        alpha = np.zeros((n, width + 1, probs.shape[1]))
        alpha[:, 0] = 1.0
        scale = np.zeros((n, probs.shape[1]))
        for end in range(1, width + 1):
            total = alpha[:, end - 1] * probs[ids[:, end - 1, 0]]
            for k in range(1, min(LONGEST, end)):
                piece = ids[:, end - 1 - k, k]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    total[hit] += alpha[hit, end - 1 - k] * probs[piece[hit]]
            alpha[:, end] = total
            yield total, scale
            if end % STRETCH == 0:
                alpha[:, max(0, end + 1 - LONGEST) : end + 1] /= total[:, None]
                scale = scale + np.log(total)

    def backward(self, codes: np.ndarray, ids: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Logs of the sums, in one language, over the segmentations of what follows each place."""
        n, width = codes.shape
        beta = np.zeros((n, width + 1))
        logs = np.full((n, width + 1), -np.inf)
        scale = np.zeros(n)
        sizes = (codes > 0).sum(axis=1)
        for at in range(width, -1, -1):
            if at < width:
                total = beta[:, at + 1] * probs[ids[:, at, 0], 0]
                for k in range(1, min(LONGEST, width - at)):
                    piece = ids[:, at, k]
                    hit = np.flatnonzero(piece >= 0)
                    if len(hit):
                        total[hit] += beta[hit, at + 1 + k] * probs[piece[hit], 0]
                beta[:, at] = total
            beta[sizes == at, at] = 1.0
            there = np.flatnonzero(sizes >= at)
            logs[there, at] = np.log(beta[there, at]) + scale[there]
            if at % STRETCH == 0:
                size = np.where(sizes >= at, beta[:, at], 1.0)
                beta[:, at : at + LONGEST] /= size[:, None]
                scale += np.log(size)
        return logs

    def _together(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Numbers and characters of words that are worked on at a time, shorter ones first."""
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        part: list[int] = []
        for k in order:
            if part and (len(part) >= 4096 or (len(part) + 1) * len(words[k]) > 4096 * WIDTH):
                yield part, self.codes([words[k] for k in part])
                part = []
            part.append(k)
        if part:
            yield part, self.codes([words[k] for k in part])

    def scores(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language, over all segmentations."""
        out = np.zeros((len(words), probs.shape[1]))
        for part, codes in self._together(words):
            sizes, rows = (codes > 0).sum(axis=1), np.array(part)
            for end, (total, scale) in enumerate(self.forward(codes, self.ids(codes), probs), 1):
                done = np.flatnonzero(sizes == end)
                if len(done):
                    out[rows[done]] = np.log(total[done]) + scale[done]
        return out

    def expected(self, words: list[str], counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in words, each seen so often, in one language."""
        out = np.zeros(len(self.pieces) + 1)
        for part, codes in self._together(words):
            ids = self.ids(codes)
            before = np.zeros((len(part), codes.shape[1] + 1))
            for end, (total, scale) in enumerate(self.forward(codes, ids, probs), 1):
                before[:, end] = np.log(total[:, 0]) + scale[:, 0]
            after = self.backward(codes, ids, probs)
            for k in range(min(LONGEST, codes.shape[1])):
                word, at = np.nonzero(ids[:, : codes.shape[1] - k, k] >= 0)
                piece = ids[word, at, k]
                share = np.exp(before[word, at] + after[word, at + k + 1] - after[word, 0])
                used = share * probs[piece, 0] * counts[part][word]
                out += np.bincount(piece, used, minlength=len(out))
        return out


def words_of(text: str) -> list[str]:
    return text.lower().split()


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class Model:
    """Languages, their piece probabilities, and the lattice."""

    def __init__(self, languages: list[str], lattice: Lattice, probs: np.ndarray):
        self.languages, self.lattice, self.probs = languages, lattice, probs
        self.key = hash((tuple(languages), probs.tobytes()))
        self.cached_words = CACHED_WORDS

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of whole texts; no language is likelier beforehand."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        cache = worker_cache("language")
        if cache.get("key") != self.key:
            cache.clear()
            cache.update(key=self.key, rows={}, scores=np.zeros((0, len(self.languages))))
        split = [words_of(t) if has_letter(t) else None for t in texts]
        seen = set().union(*[w for w in split if w])
        if len(cache["rows"]) > self.cached_words:
            cache.update(rows={}, scores=cache["scores"][:0])
        rows = cache["rows"]
        fresh = list(seen.difference(rows))
        if fresh:
            found = self.lattice.scores([MARK + w for w in fresh], self.probs)
            first = len(rows)
            rows.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            scores = cache["scores"]
            if len(scores) < len(rows):
                scores = np.zeros((max(len(rows), 2 * len(scores)), len(self.languages)))
                scores[:first] = cache["scores"][:first]
                cache["scores"] = scores
            scores[first : len(rows)] = found
        place, table = rows.__getitem__, cache["scores"]
        langs, scores = [], []
        for words in split:
            if words is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = table[np.fromiter(map(place, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            langs.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return langs, scores


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _counted(sample: DataFrame) -> DataFrame:
    """How often each word occurs in each language's sample: lang, word, n."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update([(lang, w) for w in words_of(text)])
            yield column_batch(
                schema,
                [[k[0] for k in counts], [k[1] for k in counts], list(counts.values())],
            )

    counted = sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(counted: DataFrame, languages: list[str], lattice: Lattice, probs: np.ndarray) -> DataFrame:
    """Expected uses of each piece in each language: lang, piece, n."""
    shared = counted.sparkSession.sparkContext.broadcast((languages, lattice, probs))
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int64()), ("n", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, lattice, probs = shared.value
        for batch in batches:
            words: dict[str, tuple[list, list]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = words.setdefault(lang, ([], []))
                own[0].append(MARK + word)
                own[1].append(n)
            for lang, (own, n) in words.items():
                k = languages.index(lang)
                used = lattice.expected(own, np.array(n, float), probs[:, [k]])
                there = np.flatnonzero(used)
                yield column_batch(schema, [[lang] * len(there), there, used[there]])

    made = counted.select("lang", "word", "n").mapInArrow(run, "lang string, piece long, n double")
    return made.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _normal(uses: np.ndarray) -> np.ndarray:
    """Probabilities from expected uses, with the row for uncovered characters last."""
    probs = uses + ADDED
    probs[-1] = 0
    probs /= probs.sum(axis=0)
    probs[-1] = UNSEEN
    return probs


def train(docs: DataFrame, vocabulary_path: str, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Piece probabilities of each language, by expectation and maximisation.

    Learns from text and lang of documents (with both) that are not held out: of each
    language about `sample`, those with the smallest hashes of their ids. What comes
    to the driver is one count per language, and uses of pieces of the fixed
    vocabulary. Words of all lengths are counted, so lines without spaces are too.
    """
    spark = docs.sparkSession
    usable = docs.select("doc_id", "lang", "text").where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    lattice = Lattice(public_pieces(vocabulary_path))
    languages = sorted(sizes)
    if not languages:
        return Model([], lattice, np.zeros((len(lattice.pieces) + 1, 0)))
    share = few_rows(
        spark,
        [(k, min(1.0, sample / n)) for k, n in sizes.items()],
        pa.schema([("lang", pa.string()), ("share", pa.float64())]),
    )
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    chosen = usable.join(F.broadcast(share), "lang").where(draw < F.col("share"))
    counted = kept(_counted(chosen))
    letters = np.array([len(p) for p in lattice.pieces] + [1])
    probs = np.repeat((0.5**letters)[:, None], len(languages), axis=1)
    probs = _normal(probs / probs.sum(axis=0))
    number = {k: n for n, k in enumerate(languages)}
    for _ in range(ROUNDS):
        uses = np.zeros_like(probs)
        for r in _expected(counted, languages, lattice, probs).collect():
            uses[r["piece"], number[r["lang"]]] = r["n"]
        probs = _normal(uses)
    counted.unpersist()
    return Model(languages, lattice, probs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of documents.

    Whole texts are scored word by word: a word's probability in a language sums all
    its segmentations into pieces. The score is the posterior of the best language,
    between 0 and 1; of equal languages the first by name is given. A text that is
    null or has no letter is `und` with score 0. Repeated rows are judged each on
    its own, a null doc_id stays null and counts as not held out, other columns are
    ignored, and an empty table gives no rows. Without labelled documents all texts
    are `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            langs, scores = shared.value.judge(batch.column(2).to_pylist())
            yield column_batch(schema, [batch.column(0), batch.column(1), langs, scores])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, cached_words: int = CACHED_WORDS) -> DataFrame:
    """Documents (doc_id, text, lang, source, n_chars) with a language; lang is the one found.

    Rows whose text is null or has no letter go. Repeated rows are each judged on their
    own, an empty table gives no rows, and other columns are left out. A Python worker
    keeps the scores of `cached_words` words.
    """
    model.cached_words = cached_words
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"), "source", "n_chars"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            langs, _ = shared.value.judge(batch.column(1).to_pylist())
            columns = [*batch.columns]
            columns[2] = pa.array(langs, batch.schema.field(2).type)
            made = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield made.filter(pa.array([x != UNDETERMINED for x in langs], pa.bool_()))

    return out.mapInArrow(run, out.schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs, default_vocabulary()))
