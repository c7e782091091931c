"""License scan: MinHash bands over text windows retrieve notices, exact shingles verify."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, small_batches, table, text_or_empty
from clickloom.llm.decontaminate import LOWER, SEPARATED, WORD
from clickloom.llm.license_texts import NOTICES

WORDS = 5
CONTAINED = 0.8
BANDS, BAND_ROWS = 48, 1
#: A notice contained to CONTAINED must be retrieved with this probability at least.
LEAST_PROBABILITY = 0.999
ROWS_AT_ONCE = 100

_P = np.uint64(0x100000001B3)
_P_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(2**64 - 1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a text whose other bytes are spaces."""
    octets = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], octets != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power = np.multiply.accumulate(np.full(len(octets), _P, np.uint64)) if len(octets) else octets
    sums = np.concatenate([[np.uint64(0)], np.cumsum(octets.astype(np.uint64) * power)])
    back = np.multiply.accumulate(np.full(len(octets), _P_INVERSE, np.uint64)) if len(octets) else octets
    found = (sums[ends] - sums[starts]) * back[starts] if len(starts) else np.zeros(0, np.uint64)
    found = (found ^ (found >> np.uint64(29))) * _MIX
    return starts, found ^ (found >> np.uint64(32))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """One hash per WORDS words in a row; fewer words are one shingle, none have none."""
    n = len(words)
    if not n:
        return words
    width = min(WORDS, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + len(out)]) * _MIX
        out ^= out >> np.uint64(31)
    return out


def shingles_of(words: Sequence[bytes]) -> list[tuple[bytes, ...]]:
    width = min(WORDS, len(words))
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] if words else []


def level_of(shingles: int) -> int:
    """The level whose blocks (2 to its power shingles) are the least that hold a notice."""
    return max(0, (shingles - 1).bit_length())


def least_similarity(shingles: int) -> float:
    """Least Jaccard similarity of a contained notice and a window of its level.

    A window is two blocks side by side, so a notice that begins in the first block
    lies in the window whole.
    """
    shared = math.ceil(CONTAINED * shingles)
    return shared / (2 * 2 ** level_of(shingles) + shingles - shared)


def collision_probability(similarity: float, bands: int = BANDS, rows: int = BAND_ROWS) -> float:
    return 1 - (1 - similarity**rows) ** bands


class Notices:
    """The notices' shingles and MinHash values, by level."""

    def __init__(self, notices: Sequence[tuple[str, str]], bands: int, rows: int):
        rng = np.random.default_rng(11)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = [name for name, _ in notices]
        self.shingles: list[frozenset] = []
        self.levels: dict[int, list[int]] = defaultdict(list)
        values = []
        for k, (_, text) in enumerate(notices):
            data = text.encode().lower().translate(SEPARATED)
            own = frozenset(shingles_of(data.split()))
            self.shingles.append(own)
            hashes = shingle_hashes(word_hashes(data)[1])
            if not len(hashes):
                raise ValueError("a notice has at least one word")
            if collision_probability(least_similarity(len(own)), bands, rows) < LEAST_PROBABILITY:
                raise ValueError("these bands would miss notices")
            values.append([self._mixed(hashes, f).min() for f in self.factors])
            self.levels[level_of(len(hashes))].append(k)
        self.values = np.array(values, np.uint64)

    @staticmethod
    def _mixed(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
        out = hashes * factor
        return out ^ (out >> np.uint64(32))

    def retrieve(self, hashes: np.ndarray) -> set[tuple[int, int, int]]:
        """Candidates (notice, level, block) among windows of the shingle hashes.

        `hashes` has whole blocks of the highest level, filled up with _LAST. All
        windows get all MinHash values; a candidate agrees in all rows of a band.
        """
        out: set[tuple[int, int, int]] = set()
        filled = hashes == _LAST
        top = max(self.levels)
        for band in range(self.bands):
            agree: dict[int, np.ndarray] = {}
            for row in range(self.rows):
                number = band * self.rows + row
                least = self._mixed(hashes, self.factors[number])
                least[filled] = _LAST
                for level in range(top + 1):
                    if level:
                        least = np.minimum(least[::2], least[1::2])
                    if level not in self.levels:
                        continue
                    window = least.copy()
                    np.minimum(window[:-1], least[1:], out=window[:-1])
                    for k in self.levels[level]:
                        same = window == self.values[k, number]
                        agree[k] = agree[k] & same if row else same
            for level, numbers in self.levels.items():
                for k in numbers:
                    out.update((k, level, int(b)) for b in np.flatnonzero(agree[k]))
        return out


def _matches(notice: frozenset, shingles: list[tuple], windows: list[tuple[int, int]]):
    """Spans of shingles (first, last, share of the notice) that hold a notice."""
    places: set[int] = set()
    for begin, end in windows:
        inside = [p for p in range(begin, min(end, len(shingles))) if shingles[p] in notice]
        if len({shingles[p] for p in inside}) >= CONTAINED * len(notice):
            places.update(inside)
    group: list[int] = []
    for p in [*sorted(places), None]:
        if group and (p is None or p - group[-1] > len(notice) or p - group[0] >= 2 * len(notice)):
            share = len({shingles[q] for q in group}) / len(notice)
            if share >= CONTAINED:
                yield group[0], group[-1], share
            group = []
        if p is not None:
            group.append(p)


def scan_texts(texts: Sequence[str], notices: Notices) -> Iterator[tuple[int, int, int, int, float]]:
    """Matches in texts: (text number, notice, start, end, share of its shingles)."""
    block = 2 ** max(notices.levels)
    data, parts, begins, total = [], [], [], 0
    for text in texts:
        data.append(text.encode("utf-8", "surrogatepass").lower().translate(SEPARATED))
        hashes = shingle_hashes(word_hashes(data[-1])[1])
        begins.append(total)
        size = -(-len(hashes) // block) * block
        parts.append(np.concatenate([hashes, np.full(size - len(hashes), _LAST)]))
        total += size
    if not total:
        return
    found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    starts = np.array(begins)
    for k, level, b in notices.retrieve(np.concatenate(parts)):
        at = b << level
        number = int(np.searchsorted(starts, at, "right")) - 1
        begin = at - begins[number]
        found[number, k].append((begin, begin + (2 << level)))
    words: dict[int, tuple[list, list]] = {}
    for (number, k), windows in sorted(found.items()):
        if number not in words:
            split = data[number].split()
            lower = texts[number].translate(LOWER)
            words[number] = shingles_of(split), [m.span() for m in WORD.finditer(lower)]
        shingles, spans = words[number]
        for first, last, share in _matches(notices.shingles[k], shingles, windows):
            end = spans[min(last + WORDS, len(spans)) - 1][1]
            yield number, k, spans[first][0], end, share


def find_notices(
    docs: DataFrame,
    notices: Sequence[tuple[str, str]] = NOTICES,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
) -> DataFrame:
    """License notices in documents (doc_id, text): doc_id, license_id, notice, start, end, share.

    Words are compared in lower case without marks, five to a shingle; a notice of
    fewer words is one shingle. Windows of each size in need lie over the whole
    text, half of one over half of the next. A match has at least CONTAINED of a
    notice's distinct shingles; start and end are code points, share is what it has.
    Every notice that stands so in a text is retrieved with LEAST_PROBABILITY or
    more, for which the bands are checked. Documents stay in the task that reads
    them; the notices, a list made by hand, go out with the job.

    Documents without a notice have no row; so have null and empty texts. Repeated
    rows are scanned each on its own, a null doc_id stays null, other columns are
    ignored, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Notices(notices, bands, rows))
    kinds = [
        ("doc_id", pa.int64()),
        ("license_id", pa.string()),
        ("notice", pa.int32()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("share", pa.float64()),
    ]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches, ROWS_AT_ONCE):
            ids = batch.column(0).to_pylist()
            found = [
                (ids[n], known.names[k], k, start, end, share)
                for n, k, start, end, share in scan_texts(batch.column(1).to_pylist(), known)
            ]
            yield column_batch(schema, list(zip(*found, strict=True)) if found else [[]] * len(kinds))

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    ).mapInArrow(
        run, "doc_id long, license_id string, notice int, start long, end long, share double"
    )


def op7_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_notices(table(spark, sf_dir, "documents"))
