"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import column_batch, few_rows, small_batches, stored, table, text_or_empty
from clickloom.llm.components import components

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one tile, about; a tile pair is compared in slabs of SLAB rows.
TILE = 2048
SLAB = 256
#: A tile holds fingerprints with the same bit counts in each of so many equal parts.
PARTS = 4
ROWS_AT_ONCE = 200


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bits set in over half of the hashes of the word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found) - words + 1
    if n <= 1:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    hashes = np.fromiter(
        [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())],
        np.uint64,
        n,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        octets = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, ROWS_AT_ONCE):
            found = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield column_batch(schema, [batch.column(0), signed])

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")
    ).mapInArrow(run, "doc_id long, fp long")


def part_counts(values: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Bit counts of each part of the fingerprints, one row per fingerprint."""
    octets = np.bitwise_count(values.view(np.uint8)).reshape(len(values), parts, 8 // parts)
    return octets.sum(axis=2, dtype=np.int64)


def near(radius: int, parts: int = PARTS) -> list[tuple[int, ...]]:
    """Differences of bit counts by part that fingerprints within the radius can have.

    Each differing bit changes one part's count by one, so the absolute differences
    sum to the radius at most. Of a difference and its opposite, one is given.
    """
    reach = range(-radius, radius + 1)
    zero = (0,) * parts
    return [
        d
        for d in itertools.product(reach, repeat=parts)
        if sum(map(abs, d)) <= radius and d >= zero
    ]


def close_links(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all fingerprints of two tiles that are within the radius.

    Every pair is compared by exclusive-or and bit count. Of the pairs found, those
    that a spanning forest of them needs are returned.
    """
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for at in range(0, len(a), SLAB):
        slab = a[at : at + SLAB]
        far = np.bitwise_count(slab[:, None] ^ b[None, :])
        rows, cols = np.nonzero(far <= radius)
        for x, y in zip(slab[rows].tolist(), b[cols].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                root[p] = q
                out.append((x, y))
    return out


def _tiles(values: DataFrame, tile: int) -> DataFrame:
    """Distinct fingerprints in tiles: part (a number for the bit counts by part), chunk, fps.

    Counts by part (at most 17 to the power of PARTS rows) tell how many chunks a part
    needs, so that each has about `tile` fingerprints.
    """
    spark = values.sparkSession
    width = 64 // PARTS
    part = F.lit(0).cast("int")
    for k in range(PARTS):
        piece = F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))
        part = part * (width + 1) + F.bit_count(piece)
    marked = values.withColumn("part", part)
    counts = {r[0]: r[1] for r in marked.groupBy("part").count().collect()}
    many = {p: -(-n // tile) for p, n in counts.items()}
    chunks = few_rows(
        spark, many.items(), pa.schema([("part", pa.int32()), ("chunks", pa.int32())])
    )
    return (
        marked.join(F.broadcast(chunks), "part")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .groupBy("part", "chunk", "chunks")
        .agg(F.collect_list("fp").alias("fps"))
    )


def tile_links(values: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links a, b that connect all distinct fingerprints (column fp) within the radius.

    Only tiles whose bit counts by part can be that near meet; each such pair of
    tiles is one row, compared whole. No pair within the radius is missed.
    """
    tiles = stored(_tiles(values, tile), "tiles")
    width = 64 // PARTS
    steps = near(radius)
    places = [(width + 1) ** k for k in range(PARTS - 1, -1, -1)]
    digits = [F.pmod(F.floor(F.col("part") / p), F.lit(width + 1)).cast("int") for p in places]
    sizes = tiles.select(F.col("part").alias("to"), "chunks").distinct()
    there = F.lit(0)
    inside = F.lit(True)
    for k, p in enumerate(places):
        moved = digits[k] + F.col("step")[k]
        there = there + moved * p
        inside = inside & moved.between(0, width)
    step_list = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps])
    probes = (
        tiles.select("part", "chunk", "fps", F.explode(step_list).alias("step"))
        .where(inside)
        .select("part", "chunk", "fps", there.cast("int").alias("to"))
        .join(F.broadcast(sizes), "to")
        .withColumn("to_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .where("to <> part or to_chunk >= chunk")
    )
    homes = tiles.select(
        F.col("part").alias("to"), F.col("chunk").alias("to_chunk"), F.col("fps").alias("home")
    )
    pairs = probes.join(homes, ["to", "to_chunk"]).select("fps", "home")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            found = []
            for k in range(batch.num_rows):
                x = a[k].values.to_numpy().view(np.uint64)
                y = b[k].values.to_numpy().view(np.uint64)
                found += close_links(x, y, radius)
            flat = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield column_batch(schema, [flat[:, 0], flat[:, 1]])

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of documents.

    Fingerprints link at `radius` or fewer differing bits, equal ones too; the
    component_id is the smallest doc_id that links reach. Copies share a fingerprint
    and count once in the comparison. A text without words (null too) has fingerprint
    zero. A row with a null doc_id takes part in links, but gives no component its
    name: a component of such rows only has a null one. Repeated rows stay, each
    with its result. Other columns are ignored, and an empty table gives no rows.
    """
    own = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(tile_links(classes.select("fp"), radius, tile))
    named = classes.join(
        roots.select(F.col("node").alias("fp"), "root"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = named.join(least, "root").select("fp", "component_id")
    return own.join(per_class, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that give their component its name: one of each group.

    Rows that repeat a doc_id count once. Rows without a doc_id cannot be told
    apart and all stay.
    """
    ids = found.where("doc_id = component_id").select("doc_id").distinct()
    first = docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.select(docs.columns).union(docs.where("doc_id is null"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
