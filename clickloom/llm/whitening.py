"""Whitening of embeddings with distributed block matrices of Spark MLlib."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.common import stored, table
from clickloom.llm.topk import whole_components

SHIFT = 1_000_000
COMPONENTS = 32
#: Numbers of one block, about (2 MB); its rows follow from the width of a vector. Blocks
#: grow once there are MAX_BLOCKS of them, as MLlib lists their places on the driver.
BLOCK_NUMBERS = 1 << 18
MIN_BLOCK_ROWS = 256
MAX_BLOCKS = 100_000
#: Directions whose variance is below this part of the greatest count as constant.
RANK_TOLERANCE = 1e-10

_LONG = 2**63 - 1


@dataclass
class Fit:
    """What is learned of all rows: count, exact sums, directions and their variances."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    total: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def projection(self) -> np.ndarray:
        return self.directions / np.sqrt(self.variances)


def _padded(entries: Column, width: int) -> Column:
    """Entries beyond a shorter vector's end count as zeros."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.get(entries, k), F.lit(0))
    )


def indexed(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vec_id, x (longs) and index (0..n-1) of each usable row; the count and the width.

    A row's place in its part is written down first, so that what is numbered does not
    change when a task runs again; a part's offset is the sum of the counts before it.
    """
    whole = whole_components(F.col("embedding"))
    usable = stored(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("whole"))
        .where("whole is not null")
        .select(
            "*",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        ),
        "whitening-rows",
    )
    counts = usable.groupBy("part").agg(
        (F.max("place") + 1).alias("rows"), F.max(F.size("whole")).alias("width")
    )
    found = sorted(counts.collect())
    n, width = sum(r.rows for r in found), max((r.width for r in found), default=0)
    if not n or not width:
        return usable.select("vec_id", "whole", "place").toDF("vec_id", "x", "index"), n, width
    ends = np.cumsum([r.rows for r in found]).tolist()
    offsets = vectors.sparkSession.createDataFrame(
        [(r.part, end - r.rows) for r, end in zip(found, ends, strict=True)], "part int, offset long"
    )
    room = F.lit(_LONG - SHIFT)
    x = F.transform(_padded(F.col("whole"), width), lambda c: F.least(c, room) + SHIFT)
    rows = usable.join(F.broadcast(offsets), "part")  # one row per part of the input
    return rows.select("vec_id", x.alias("x"), (F.col("offset") + F.col("place")).alias("index")), n, width


def _block_rows(n: int, width: int) -> int:
    return max(MIN_BLOCK_ROWS, BLOCK_NUMBERS // width, -(-n // MAX_BLOCKS))


def _blocks(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """Rows (index, v: doubles) as a matrix of blocks, each some rows and all columns."""
    lines = rows.select("index", array_to_vector("v").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(lines, "vector"), n, width)
    return matrix.toBlockMatrix(_block_rows(n, width), width)


def _gram(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The matrix's transpose times itself, a small matrix.

    Block products are summed in `splits` parts before they meet, so that no task reads
    all rows. That argument is public in MLlib but not passed on by its Python class.
    """
    product = matrix.transpose()._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits
    )
    found = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (found + found.T) / 2


def _centred(entries: Column, means: list[float]) -> Column:
    return F.zip_with(entries, F.array(*map(F.lit, means)), lambda a, m: a.cast("double") - m)


def _splits(n: int, width: int, spark: SparkSession) -> int:
    blocks = -(-n // _block_rows(n, width))
    return max(1, min(blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fit(rows: DataFrame, n: int, width: int, components: int = COMPONENTS) -> tuple[Fit, BlockMatrix]:
    """Directions of greatest variance of rows (index, x), and the centred rows as blocks."""
    spark = rows.sparkSession
    each = rows.select(F.posexplode("x").alias("at", "c"))
    sums = each.groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s")).collect()
    whole = [int(r.s) for r in sorted(sums)]
    means = [s / n for s in whole]
    matrix = _blocks(rows.select("index", _centred(F.col("x"), means).alias("v")), n, width)
    covariance = _gram(matrix, _splits(n, width, spark)) / n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK_TOLERANCE * max(values.max(), 0.0)]
    axes = axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    return Fit(n, whole, values[order], axes, float(np.trace(covariance))), matrix


def project(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """index and z (doubles): each row of the matrix times the weights."""
    height, width = weights.shape
    block = ((0, 0), Matrices.dense(height, width, weights.flatten("F").tolist()))
    right = BlockMatrix(spark.sparkContext.parallelize([block], 1), height, width, height, width)
    product = matrix.multiply(right).toIndexedRowMatrix()
    lines = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return lines.select("index", vector_to_array("vector").alias("z"))


def identity_error(projected: DataFrame, n: int, width: int) -> float:
    """Largest absolute entry of the covariance of z minus the identity."""
    each = projected.select(F.posexplode("z").alias("at", "c"))
    means = [r[1] for r in sorted(each.groupBy("at").agg(F.sum("c") / n).collect())]
    matrix = _blocks(projected.select("index", _centred(F.col("z"), means).alias("v")), n, width)
    found = _gram(matrix, _splits(n, width, projected.sparkSession)) / n
    return float(np.abs(found - np.eye(width)).max())


def _deviation(model: Fit) -> Column:
    """Sum over dimensions of (n*x - S)^2, exact; null where it is beyond a long."""
    pairs = F.arrays_zip(
        F.col("x").alias("x"), F.array(*[F.lit(s).cast("decimal(38,0)") for s in model.sums]).alias("s")
    )
    far = F.aggregate(
        pairs, F.lit(0.0), lambda t, p: t + F.pow(model.n * p["x"].cast("double") - p["s"].cast("double"), 2)
    )
    term = lambda p: (F.lit(model.n) * p["x"]) - p["s"].cast("long")
    exact = F.aggregate(pairs, F.lit(0).cast("long"), lambda t, p: t + term(p) * term(p))
    return F.when(far < 9.2e18, exact)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error.

    vectors has vec_id and embedding. Each entry becomes x = floor(64 * entry) + SHIFT.
    The centred rows are a matrix of distributed blocks; its transpose times itself
    gives the covariance (divisor n), whose eigenvectors are found on the driver (a
    matrix as wide as a vector), and the blocks times those, over the roots of their
    variances, give the whitened rows. One row each comes out per vector and component,
    numbered from 1 by falling variance. Of the driver's work nothing grows with the
    rows but one count per part and the list of blocks.

    Vectors that are null or hold a null or non-finite entry take no part. A shorter
    vector counts as zero beyond its end. Repeated rows count and come out each on its
    own, a null vec_id stays null. Directions without variance (all vectors alike, fewer
    vectors than dimensions) have no rows, as they cannot be scaled to one. Entries
    beyond a long become the nearest one; a deviation or product n*x beyond a long is
    null. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows, n, width = indexed(vectors)
    empty = (
        "vec_id long, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    if not n or not width:
        return spark.createDataFrame([], empty)
    model, matrix = fit(rows, n, width, components)
    if not len(model.variances):
        return spark.createDataFrame([], empty)
    projected = stored(project(spark, matrix, model.projection()), "whitening-projected")
    error = identity_error(projected, n, len(model.variances))
    most = rows.agg(F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    fits = n * max(abs(most[0]), abs(most[1])) < _LONG // 2
    deviation = _deviation(model) if fits else F.lit(None).cast("long")
    shares = F.array(*[F.lit(float(e / model.total)) for e in model.variances])
    return (
        rows.select("index", "vec_id", deviation.alias("deviation"))
        .join(projected, "index")
        .select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
        .select(
            "vec_id",
            (F.col("at") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(shares, F.col("at")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
