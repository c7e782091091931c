"""Embedding near-duplicates over a neighbour graph refined by NN-descent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import stored, table
from clickloom.llm.components import components

#: Least cosine of two linked vectors.
LEAST = 0.95
#: Neighbours kept for each vector at first, and the longest list that is enlarged to.
LIST, LONGEST = 12, 48
#: Nearest vectors that name a vector as their neighbour and meet with its own list.
NAMED_BY = 24
#: First lists come from blocks of so many vectors next to each other in each of TABLES
#: orders by random directions.
BLOCK, TABLES, BITS = 256, 4, 62
#: Rounds end when fewer than this part of the list entries are new.
SETTLED, MAX_ROUNDS = 0.01, 15
#: Vectors whose links are counted by brute force, and the recall that must be reached;
#: with less, lists are made longer and rounds go on, at most AUDITS times.
AUDITED, RECALL, AUDITS = 1024, 0.95, 3
#: Vectors of one tile where dense groups are compared whole.
TILE = 1024
SEED = 42

PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
PAIRS_DDL = "u long, v long, sim double"


def units(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of length one in double precision; shorter ones are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)  # keeps squares in range
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups, of batches sorted by a key."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        keys = rows[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _pairs(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[], [], []]
    kinds = (np.int64, np.int64, np.float64)
    arrays = [pa.array(np.asarray(c, k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=PAIRS)


def nearest(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest others of each vector of a block, as pairs."""
    sims = vectors @ vectors.T
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], sims[0, :0]
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(ids)), k)
    return ids[rows], ids[best.ravel()], sims[rows, best.ravel()]


def introduce(ids, fresh, vectors, floors, limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs among one vector's neighbours that better a list: the local join.

    Pairs of two known neighbours met before. Of one neighbour's new acquaintances as
    many are told as its list is long, and only those nearer than its list's last.
    """
    sims = vectors @ vectors.T
    met = ~(fresh[:, None] | fresh[None, :])
    met |= sims <= floors[:, None]
    np.fill_diagonal(met, True)
    most = int(limits.max())
    if len(ids) > most + 1:
        order = np.argpartition(np.where(met, 2.0, -sims), most - 1, axis=1)[:, :most]
        told = np.zeros_like(met)
        np.put_along_axis(told, order, True, axis=1)
        met |= ~told
    rows, cols = np.nonzero(~met)
    return ids[rows], ids[cols], sims[rows, cols]


def classes(vectors: DataFrame) -> DataFrame:
    """Different usable vectors: node (a number), v, n (rows that hold it), first_id."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.forall("embedding", number) & F.exists("embedding", lambda x: x != 0)
    found = (
        vectors.where(F.col("embedding").isNotNull() & usable)
        .groupBy("embedding")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("vec_id").cast("long")).alias("first_id"))
    )
    named = found.select(
        F.monotonically_increasing_id().alias("node"), F.col("embedding").alias("v"), "n", "first_id"
    )
    return stored(named, "vector-classes")


class Graph:
    """Neighbour lists of all nodes (u, v, sim, fresh), refined in rounds.

    `limits` has how long each node's list may get. Lists and limits are stored tables,
    written anew by each round; the driver sees counts only.
    """

    def __init__(self, nodes: DataFrame, size: int, width: int, length: int):
        self.nodes, self.size, self.width = nodes, size, width
        self.parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.limits = stored(nodes.select("node", F.lit(length).alias("k")), "list-limits")
        self.lists: DataFrame | None = None

    def seed(self, turn: int) -> None:
        """Neighbours within blocks of the orders by random directions, as a first guess.

        A vector's code in an order is on which sides of BITS random planes it lies, so
        vectors that agree in the first ones stand near each other. Blocks are cut off the
        sorted rows by their number, so no group is larger than a block.
        """
        width, tables, length = self.width, TABLES, LIST
        draw = np.random.default_rng(SEED + turn)
        planes = draw.normal(size=(tables, BITS, width))
        scale = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        kind = self.nodes.schema["v"].dataType.simpleString()
        codes = pa.schema([("t", pa.int32()), ("code", pa.int64()), ("node", pa.int64())])

        def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = units(batch.column(1), width)
                for t in range(tables):
                    code = (found @ planes[t].T > 0) @ scale
                    columns = [pa.array(np.full(len(code), t, np.int32)), pa.array(code), batch.column(0)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, batch.column(1)], schema=codes.append(pa.field("v", batch.column(1).type))
                    )

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in runs(batches, "t"):
                ids, found = rows["node"].to_numpy(), units(rows["v"], width)
                cuts = np.linspace(0, len(ids), max(1, round(len(ids) / BLOCK)) + 1).astype(int)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield _pairs([nearest(ids[a:b], found[a:b], length)])

        coded = self.nodes.select("node", "v").mapInArrow(
            sides, f"t int, code long, node long, v {kind}"
        )
        dealt = coded.repartitionByRange(self.parts, "t", "code", "node").sortWithinPartitions("t", "code", "node")
        self._merge(dealt.mapInArrow(blocks, PAIRS_DDL))

    def round(self) -> int:
        """Neighbours of each node meet each other; how many list entries are new after that."""
        lists = self.lists
        named = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
        back = (
            lists.withColumn("place", F.row_number().over(named))
            .where(F.col("place") <= NAMED_BY)
            .select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")
        )
        both = lists.select("u", "v", "fresh").union(back).groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        busy = both.where("fresh").select("u").distinct()
        full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("entries"), F.min("sim").alias("last"))
        heads = (
            self.nodes.select("node", "v")
            .withColumnRenamed("v", "vector")
            .join(self.limits, "node")
            .join(full.withColumnRenamed("u", "node"), "node", "left")
            .select(
                F.col("node").alias("v"), "vector", "k",
                F.when(F.col("entries") >= F.col("k"), F.col("last")).otherwise(-2.0).alias("floor"),
            )
        )
        meeting = (
            both.join(busy, "u", "left_semi")
            .join(heads, "v")
            .select("u", "v", "fresh", "vector", "k", "floor")
            .repartition("u")
            .sortWithinPartitions("u")
        )
        width = self.width

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in runs(batches, "u"):
                owner, ids = rows["u"].to_numpy(), rows["v"].to_numpy()
                fresh = rows["fresh"].to_numpy()
                floors, limits = rows["floor"].to_numpy(), rows["k"].to_numpy()
                found = units(rows["vector"], width)
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out = []
                for a, b in zip(starts, np.r_[starts[1:], len(owner)], strict=True):
                    if b - a > 1:
                        out.append(introduce(ids[a:b], fresh[a:b], found[a:b], floors[a:b], limits[a:b]))
                yield _pairs(out)

        return self._merge(meeting.mapInArrow(meet, PAIRS_DDL))

    def _merge(self, found: DataFrame) -> int:
        """The nearest of old entries and new pairs become the lists; entries are fresh once."""
        told = found.withColumn("known", F.lit(False))
        if self.lists is not None:
            told = told.union(self.lists.select("u", "v", "sim", F.lit(True).alias("known")))
        order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
        ranked = (
            told.repartition("u")
            .groupBy("u", "v")
            .agg(F.max("sim").alias("sim"), F.max("known").alias("known"))
            .withColumn("place", F.row_number().over(order))
            .where(F.col("place") <= LONGEST)
            .join(self.limits.withColumnRenamed("node", "u"), "u")
            .where("place <= k")
            .select("u", "v", "sim", (~F.col("known")).alias("fresh"))
        )
        self.lists = stored(ranked, "neighbour-lists")
        return self.lists.where("fresh").count()

    def settle(self) -> None:
        """Rounds until hardly an entry is new; then full lists of links are made longer."""
        for _ in range(MAX_ROUNDS):
            if self.round() < SETTLED * LIST * self.size and not self.enlarge():
                return

    def saturated(self, least: float) -> DataFrame:
        """Nodes whose list is full and holds links only, so that more links may exist."""
        full = self.lists.groupBy("u").agg(F.count(F.lit(1)).alias("entries"), F.min("sim").alias("last"))
        return full.join(self.limits.withColumnRenamed("node", "u"), "u").where(
            (F.col("entries") >= F.col("k")) & (F.col("last") >= least)
        ).select(F.col("u").alias("node"), "k")

    def enlarge(self, everywhere: bool = False) -> int:
        """Twice as long lists for saturated nodes (or all) below LONGEST; how many there are."""
        chosen = self.limits if everywhere else self.saturated(LEAST)
        chosen = stored(chosen.where(F.col("k") < LONGEST).select("node"), "enlarged")
        many = chosen.count()
        if many:
            marked = chosen.withColumn("more", F.lit(True))
            longer = F.when(F.col("more"), F.least(F.col("k") * 2, F.lit(LONGEST))).otherwise(F.col("k"))
            self.limits = stored(
                self.limits.join(marked, "node", "left").select("node", longer.cast("int").alias("k")),
                "list-limits",
            )
            again = marked.select(F.col("node").alias("u"), "more")
            self.lists = stored(
                self.lists.join(again, "u", "left").select(
                    "u", "v", "sim", (F.col("fresh") | F.coalesce("more", F.lit(False))).alias("fresh")
                ),
                "neighbour-lists",
            )
        return many


def _whole_groups(members: DataFrame, width: int, least: float, size: int) -> DataFrame:
    """u and links of each member (root, node, v, n) of groups that are compared whole.

    A group's members are dealt to tiles, each pair of tiles is one row, and only sums
    per member come out, never pairs.
    """
    chunks = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("chunks"))
    tiles = stored(
        members.join(chunks, "root")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .groupBy("root", "chunk", "chunks")
        .agg(F.collect_list("node").alias("ids"), F.collect_list("n").alias("ns"), F.collect_list("v").alias("vs")),
        "group-tiles",
    )
    asked = tiles.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    there = tiles.select(
        "root", F.col("chunk").alias("to"), F.col("ids").alias("ids2"),
        F.col("ns").alias("ns2"), F.col("vs").alias("vs2"),
    )
    pairs = asked.join(there, ["root", "to"]).select("ids", "vs", "ids2", "ns2", "vs2")
    schema = pa.schema([("u", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, vs, ids2, ns2, vs2 = (c[k].values for c in batch.columns)
                near = units(vs, width) @ units(vs2, width).T >= least
                ids = ids.to_numpy()
                near &= ids[:, None] != ids2.to_numpy()[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(near.astype(np.int64) @ ns2.to_numpy())], schema=schema
                )

    return pairs.mapInArrow(count, "u long, links long").groupBy("u").agg(F.sum("links").alias("links"))


def _links(graph: Graph, least: float) -> tuple[DataFrame, DataFrame]:
    """links per node (u, links: rows of other vectors linked) and components (node, root).

    Nodes whose lists stay full of links at LONGEST belong to dense groups. What is
    connected to one is compared whole, so that none of its links is missed.
    """
    near = graph.lists.where(F.col("sim") >= least).select("u", "v")
    pairs = stored(near.union(near.select("v", "u")).distinct(), "links")
    roots = stored(components(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots")
    named = roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
    dense = graph.saturated(least).join(named, "node").select("root").distinct()
    members = named.join(dense, "root", "left_semi").join(graph.nodes.select("node", "v", "n"), "node")
    whole = _whole_groups(members, graph.width, least, TILE)
    listed = (
        pairs.join(graph.nodes.select(F.col("node").alias("v"), "n"), "v")
        .groupBy("u")
        .agg(F.sum("n").alias("listed"))
    )
    counts = listed.join(whole, "u", "left").select("u", F.coalesce("links", "listed").alias("links"))
    return stored(counts, "link-counts"), named


def audit(graph: Graph, counts: DataFrame, least: float) -> float:
    """Recall of links: brute force for the AUDITED nodes of smallest hash against all rows.

    The lower of two figures: part of all their links that are found, and the mean of
    that part over the nodes that have links.
    """
    asked = graph.nodes.orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", "v").toArrow()
    ids, own, width = asked["node"].to_numpy(), units(asked["v"], graph.width), graph.width
    schema = pa.schema([("u", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            near = units(batch.column(1), width) @ own.T >= least
            near &= batch.column(0).to_numpy()[:, None] != ids[None, :]
            total += batch.column(2).to_numpy() @ near.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], schema=schema)

    true = (
        graph.nodes.select("node", "v", "n")
        .mapInArrow(count, "u long, links long")
        .groupBy("u")
        .agg(F.sum("links").alias("every"))
        .where("every > 0")
    )
    found = true.join(counts, "u", "left").select(
        "every", F.least("every", F.coalesce("links", F.lit(0))).alias("found")
    )
    got = found.agg(F.sum("found") / F.sum("every"), F.avg(F.col("found") / F.col("every"))).first()
    return 1.0 if got[0] is None else float(min(got))


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept and audited_recall of each row of vectors.

    vectors has vec_id and embedding. Equal vectors are one node. Nodes get first lists of
    neighbours from blocks of random orders; in each round the neighbours of a node meet,
    and who is nearer than a list's last takes its place. Lists that are full of links are
    made twice as long, up to LONGEST; what is connected to a node that is still full
    there is compared whole, tile by tile. Pairs found with a cosine (double precision) of
    `least` or more are links. Links of AUDITED vectors are counted by brute force; below a
    recall of RECALL all lists are made longer, seeded anew and refined again. The recall
    that the last audit found is given with each row.

    n_links counts the other rows linked, equal vectors too; component_id is the smallest
    vec_id that links reach, and kept says whether it is the row's own. Vectors that are null,
    empty, zero or hold a null or non-finite entry link with nothing. Shorter vectors
    count as zero beyond their end. A row with a null vec_id takes part, but names no component
    and is not kept; rows that share a vec_id each have their own result. Other columns are
    ignored; an empty table gives no rows.
    """
    nodes = classes(vectors)
    size, width = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if not size:
        alone = own.withColumn("n", F.lit(1)).withColumn("links", F.lit(0))
        return _result(alone.withColumn("least_id", F.col("vec_id")), 1.0)
    graph = Graph(nodes, size, width, LIST)
    for turn in range(AUDITS):
        graph.seed(turn)
        graph.settle()
        counts, named = _links(graph, least)
        recall = audit(graph, counts, least)
        if recall >= RECALL or turn == AUDITS - 1 or not graph.enlarge(everywhere=True):
            break
    placed = (
        nodes.join(counts.withColumnRenamed("u", "node"), "node", "left")
        .join(named, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    ids = placed.groupBy("root").agg(F.min("first_id").alias("least_id"))
    by_vector = placed.join(ids, "root").select(F.col("v").alias("embedding"), "n", "links", "least_id")
    return _result(own.join(by_vector, "embedding", "left"), recall)


def _result(rows: DataFrame, recall: float) -> DataFrame:
    alone = F.col("n").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("least_id"))
    links = F.when(alone, 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("n") - 1)
    return rows.select(
        "vec_id",
        links.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
        F.lit(recall).alias("audited_recall"),
    )


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
