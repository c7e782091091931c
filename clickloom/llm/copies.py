"""Near copies by word shingles: MinHash bands propose, exact similarity decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, small_batches, stored, text_or_empty
from clickloom.llm.components import components

WORDS = 5
#: Least Jaccard similarity of the sets of shingles of two near copies.
LEAST = 0.8
#: Two texts are compared if a band's ROWS smallest hashes agree, by themselves or through
#: others. At a similarity of 0.8 that misses (1 - 0.8**5)**24, or 7 pairs in 100,000.
BANDS, ROWS = 24, 5
#: Shingles of one chunk, about; the chunks of a group of candidates meet in pairs.
CHUNK = 100_000
SEED = 42
ROWS_AT_ONCE = 200

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS = _FACTORS * np.uint64(2) + np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct word shingles, in order; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    known = {w: xxh64_intdigest(w, SEED) for w in set(found)}
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    total = np.zeros(min(n, len(found)), np.uint64)
    for k in range(min(words, len(found))):
        total = total * _BASE + hashes[k : k + n]
    return np.unique(_mixed(total))


def bands(found: np.ndarray) -> list[int]:
    """One signed number per band, of its smallest hashes; none for a text without words."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(found), 2048):
        least = np.minimum(least, (found[at : at + 2048] * _FACTORS).min(axis=1))
    total = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        total = _mixed(total * _BASE + column)
    return total.view(np.int64).tolist()


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, own, key (of the set of shingles) and bands of each row with text and own."""
    from xxhash import xxh64_intdigest

    schema = pa.schema(
        [("doc_id", pa.int64()), ("own", pa.int64()), ("key", pa.int64()), ("bands", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            keys = np.array([xxh64_intdigest(x.tobytes(), SEED) for x in found], np.uint64)
            yield column_batch(
                schema, [batch.column(0), batch.column(1), keys.view(np.int64), [bands(x) for x in found]]
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "own", text_or_empty().alias("text")
    ).mapInArrow(run, "doc_id long, own long, key long, bands array<long>")


def similar_links(
    a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]], least: float = LEAST
) -> list[tuple[int, int]]:
    """Links that join all similar sets of a and b (numbers with sets): pairs already joined are passed over."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, own in a:
        for y, other in b:
            small, large = sorted((len(own), len(other)))
            if x == y or small < least * large or (p := top(x)) == (q := top(y)):
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= least * (small + large - both):
                root[p] = q
                out.append((x, y))
    return out


def _verified(candidates: DataFrame) -> DataFrame:
    """Links a, b of keys whose texts are similar; candidates have root, key and text.

    The texts of a root are dealt to chunks, and each pair of chunks is one row, compared
    whole; so a large group is no single task's work.
    """
    schema = pa.schema(
        [("root", pa.int64()), ("key", pa.int64()), ("found", pa.binary()), ("n", pa.int64())]
    )

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            yield column_batch(
                schema,
                [batch.column(0), batch.column(1), [x.tobytes() for x in found], list(map(len, found))],
            )

    sets = stored(
        candidates.select("root", "key", "text").mapInArrow(
            prepare, "root long, key long, found binary, n long"
        ),
        "shingles",
    )
    sizes = sets.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    chunks = stored(
        sets.join(sizes, "root")
        .withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
        .groupBy("root", "chunk", "chunks")
        .agg(F.collect_list("key").alias("keys"), F.collect_list("found").alias("sets")),
        "chunks",
    )
    inside = chunks.select("keys", "sets", F.col("keys").alias("keys2"), F.col("sets").alias("sets2"))
    several = chunks.where("chunks > 1")
    probes = several.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where(
        "to > chunk"
    )
    homes = several.select(
        "root", F.col("chunk").alias("to"), F.col("keys").alias("keys2"), F.col("sets").alias("sets2")
    )
    across = probes.join(homes, ["root", "to"]).select("keys", "sets", "keys2", "sets2")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for k in range(batch.num_rows):
                keys, sets, keys2, sets2 = (c[k].as_py() for c in batch.columns)
                a = [(x, np.frombuffer(s, np.uint64)) for x, s in zip(keys, sets, strict=True)]
                b = [(x, np.frombuffer(s, np.uint64)) for x, s in zip(keys2, sets2, strict=True)]
                links += similar_links(a, b)
            flat = np.array(links, np.int64).reshape(-1, 2)
            yield column_batch(out, [flat[:, 0], flat[:, 1]])

    return inside.union(across).mapInArrow(compare, "a long, b long")


def _group_links(found: DataFrame, signed: DataFrame) -> DataFrame:
    """Links a, b of keys that join all rows (by own) of each group (component_id)."""
    keyed = found.select(F.col("doc_id").alias("own"), "component_id").join(
        signed.select("own", "key"), "own"
    )
    keyed = keyed.select("component_id", "key").distinct()
    least = keyed.groupBy("component_id").agg(F.min("key").alias("a"), F.max("key").alias("most"))
    return (
        keyed.join(least.where("a < most").select("component_id", "a"), "component_id")
        .select("a", F.col("key").alias("b"))
        .where("a < b")
    )


def keep_one(docs: DataFrame, method: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id, then by a hash of the row.

    `method` may give further groups: of rows (doc_id, text) it tells the component_id, as
    `simhash.near_duplicates` does; doc_id is then a number for each different row.
    Texts link if the Jaccard similarity of their sets of WORDS-word shingles (case and
    white space folded) is LEAST or more, and groups are what links reach. Rows without a
    doc_id come last; different texts with one doc_id are told apart; of equal rows one
    stays. Texts without words (null too) are copies of each other. An empty table gives
    no rows. Other columns stay, whatever their names. Rows and sets of shingles are known by
    hashes of 64 bits.
    """
    marked = docs.select(
        F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64(*docs.columns).alias("own")
    )
    signed = stored(_signed(marked), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("own"))).alias("first")
    classes = stored(
        signed.groupBy("key").agg(least, F.first("bands").alias("bands")), "classes"
    )
    dealt = classes.select(F.explode("bands").alias("band"), "key")
    shared = dealt.groupBy("band").agg(F.min("key").alias("a"), F.max("key").alias("most"))
    meet = dealt.join(shared.where("a < most").select("band", "a"), "band")
    near = components(meet.select("a", F.col("key").alias("b")).where("a < b"))
    near = stored(near.union(near.select(F.col("root").alias("node"), "root")).distinct(), "near")
    members = classes.select("key", F.col("first.own").alias("own")).join(
        near.withColumnRenamed("node", "key"), "key"
    )
    links = _verified(marked.select("own", "text").join(members, "own").dropDuplicates(["key"]))
    if method:
        found = method(marked.select(F.col("own").alias("doc_id"), "text"))
        links = links.union(_group_links(found, signed))
    roots = components(links).select(F.col("node").alias("key"), "root")
    kept = (
        classes.select("key", "first")
        .join(roots, "key", "left")
        .groupBy(F.coalesce("root", "key").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.own").alias("own"))
    )
    return marked.join(kept, "own", "left_semi").dropDuplicates(["own"]).select("row.*")
