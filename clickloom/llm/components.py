"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import stored

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """The smallest node (root) each linked node can reach; links have columns a, b (long).

    Rounds of two steps, each a minimum per node that is combined before the shuffle:
    first all larger neighbours of a node are hung on its smallest neighbour, then
    all smaller ones. The links end as stars around their roots, after a number of
    rounds that grows with the logarithm of the longest path. Every round is stored
    in the shared folder. Nulls in links are left out, repeated links and links of
    a node with itself change nothing, and no links give no rows.
    """
    star = stored(
        links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .where("v > u")
        .distinct(),
        "links",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        state = star.agg(
            F.count(F.lit(1)), F.sum(F.hash("v", "u").cast("long")), F.sum(F.col("u").cast("decimal(20,0)")).cast("string")
        ).first()
        if state == before or not state[0]:
            return star.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
        star = stored(_small_star(_large_star(star)), "star")
    raise RuntimeError("the links did not settle")


def _large_star(star: DataFrame) -> DataFrame:
    both = star.select("v", "u").union(star.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("least"))
    return (
        both.join(least, "v")
        .where("u > v")
        .select(F.col("u").alias("v"), F.least("least", F.col("v")).alias("u"))
        .distinct()
    )


def _small_star(star: DataFrame) -> DataFrame:
    least = star.groupBy("v").agg(F.min("u").alias("least"))
    joined = star.join(least, "v")
    return (
        joined.select("v", F.col("least").alias("u"))
        .union(joined.select(F.col("u").alias("v"), F.col("least").alias("u")).where("v > u"))
        .distinct()
    )
