"""Exact top-k search by term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import kept, table

K = 20
EVERY = 20
SCALE = 64
#: Rows of one block of queries and of one block of candidates, about.
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
#: Queries whose score arrays are filled at once.
SCORE_ROWS = 128

_LONG = 2**63 - 1


def whole_components(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null if the vector or a component is not a finite number."""
    sound = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(
        vector.isNotNull() & sound,
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")),
    )


class Postings:
    """For each term, the rows that have it and their weights."""

    def __init__(self, offsets: np.ndarray, weights: np.ndarray):
        self.rows = len(offsets) - 1
        owner = np.repeat(np.arange(self.rows), np.diff(offsets))
        term = np.arange(len(weights)) - np.repeat(offsets[:-1], np.diff(offsets))
        there = weights != 0
        owner, term, weights = owner[there], term[there], weights[there]
        order = np.argsort(term, kind="stable")
        self.terms, starts = np.unique(term[order], return_index=True)
        self.lists = list(
            zip(
                np.split(owner[order], starts[1:]),
                np.split(weights[order], starts[1:]),
                strict=True,
            )
        )
        if not len(self.terms):
            self.lists = []
        self.most = int(np.abs(weights.astype(object)).max()) if len(weights) else 0

    def by_term(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return dict(zip(self.terms.tolist(), self.lists, strict=True))


def accumulate(queries: Postings, docs: Postings) -> np.ndarray:
    """Scores of all queries (rows) against all candidates (columns).

    One term at a time: each query with the term adds its weight times the posting's
    to the candidates on the term's list. A list that holds nearly every candidate is
    added as a whole column. Numbers are 32 bits wide where no sum can leave them.
    """
    bound = queries.most * docs.most * max(1, len(docs.terms))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    scores = np.zeros((queries.rows, docs.rows), kind)
    lists = docs.by_term()
    for term, (rows, weights) in queries.by_term().items():
        if term not in lists:
            continue
        ids, values = lists[term]
        weights, values = weights.astype(kind), values.astype(kind)
        if 4 * len(ids) >= 3 * docs.rows:
            column = np.zeros(docs.rows, kind)
            column[ids] = values
            added = np.multiply.outer(weights, column)
            if len(rows) == queries.rows:
                scores += added
            else:
                scores[rows] += added
        else:
            scores[np.ix_(rows, ids)] += np.multiply.outer(weights, values)
    return np.clip(scores, -_LONG - 1, _LONG).astype(np.int64) if kind is object else scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Row, id and score of each query's k best candidates, ties to smaller ids.

    `ids` are sorted. Partition selection finds the k-th score; scores above it are
    kept, and of those equal to it the first ids.
    """
    for q in range(len(scores)):
        line, left = scores[q], slice(np.searchsorted(ids, own[q]), np.searchsorted(ids, own[q], "right"))
        there = np.ones(len(ids), bool)
        there[left] = False
        n = int(there.sum())
        if n > k:
            cut = np.partition(line[there], n - k)[n - k]
            above = np.flatnonzero(there & (line > cut))
            equal = np.flatnonzero(there & (line == cut))[: k - len(above)]
            chosen = np.concatenate([above, equal])
        else:
            chosen = np.flatnonzero(there)
        yield q, ids[chosen], line[chosen].astype(np.int64)


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths(), np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten().to_numpy(zero_copy_only=False)


def _search(queries: pa.Table, docs: pa.Table, k: int) -> Iterator[tuple]:
    """The k best candidates of one block for each query of one block."""
    docs = docs.sort_by("vec_id")
    ids = docs["vec_id"].to_numpy()
    postings = Postings(*_flat(docs["weights"]))
    for at in range(0, queries.num_rows, SCORE_ROWS):
        part = queries.slice(at, SCORE_ROWS)
        own = part["vec_id"].to_numpy()
        scores = accumulate(Postings(*_flat(part["weights"])), postings)
        for q, found, line in best(scores, ids, own, k):
            yield own[q], found, line


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query.

    vectors has vec_id and embedding; queries are the rows whose vec_id is divisible
    by `every`, candidates all rows with another vec_id. Rows are dealt by hashes to
    blocks of bounded size (candidates by vec_id and place, so that many rows of one
    vec_id are spread), and each block of queries meets each block of candidates in
    one task, which keeps k rows per query. A window over those finds the k best of all.

    Vectors that are null or hold a null or non-finite component, and rows with a
    null vec_id, take no part. Vectors of different lengths are compared over the
    components both have; an empty one scores 0. Repeated rows of a vec_id are
    candidates each on its own, but one query; their vectors being different, the
    query is the smallest one. Other columns are ignored; an empty table gives no
    rows. Scores beyond a long become the nearest long.
    """
    usable = kept(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            whole_components(F.col("embedding")).alias("weights"),
            F.monotonically_increasing_id().alias("row"),
        ).where("vec_id is not null and weights is not null")
    )
    asked = F.col("vec_id") % every == 0
    sizes = usable.agg(F.count(F.lit(1)), F.count(F.when(asked, 1))).first()
    n_docs = max(1, -(-sizes[0] // CANDIDATE_BLOCK))
    n_asked = max(1, -(-sizes[1] // QUERY_BLOCK))
    block = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = (
        usable.where(asked)
        .groupBy("vec_id")
        .agg(F.min("weights").alias("weights"))
        .select("vec_id", "weights", block(n_asked, "vec_id").alias("q"))
        .withColumn("d", every_block(n_docs))
    )
    docs = usable.withColumn("d", block(n_docs, "vec_id", "row")).drop("row").withColumn("q", every_block(n_asked))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def meet(asked_block: pa.Table, docs_block: pa.Table) -> pa.Table:
        if not asked_block.num_rows or not docs_block.num_rows:
            return schema.empty_table()
        rows = list(_search(asked_block, docs_block, k))
        counts = [len(found) for _, found, _ in rows]
        return pa.table(
            [
                np.repeat(np.array([r[0] for r in rows], np.int64), counts),
                np.concatenate([r[1] for r in rows]),
                np.concatenate([r[2] for r in rows]),
            ],
            schema=schema,
        )

    found = (
        queries.groupBy("q", "d")
        .cogroup(docs.groupBy("q", "d"))
        .applyInArrow(meet, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op4_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id,
         [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_dot_product(CAST(a.w AS DOUBLE[]), CAST(b.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
