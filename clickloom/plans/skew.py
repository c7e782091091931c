"""Joins of a large side with a lookup side that survive hot keys.

A lookup side that Spark will broadcast anyway (its size estimate is below
`spark.sql.autoBroadcastJoinThreshold`) needs nothing more: the large side does
not move. Otherwise the large side is shuffled on the key, and a key that holds
a large share of the rows would end in one task. The heaviest keys are found
with a pre-aggregated count; their rows are spread over several salts and only
their lookup rows are repeated, once per salt.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of the session settings that tune this: how many keys may count as
# heavy, from how many rows on, and the least number of salts their rows are spread
# over. A key gets one salt for each `heavyRows` rows, so its share of a task stays
# the same as it grows, up to SALT_GROWTH times that number.
SETTINGS = {
    "clickloom.heavyKeys": 1000,
    "clickloom.heavyRows": 1_000_000,
    "clickloom.salts": 64,
}

SALT_GROWTH = 64

_UNHASHABLE = re.compile(r"map<|variant")
_SALT = "_salt"
_SALTS = "_salts"


def setting(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(SETTINGS[name])))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate puts `df` below the broadcast threshold."""
    plan = getattr(df, "_jdf", None)
    if plan is None:  # a remote session does not show the plan
        return False
    limit = plan.sparkSession().sessionState().conf().autoBroadcastJoinThreshold()
    estimate = plan.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(estimate)) <= int(limit)


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key without NULL, counted before the shuffle: (*keys, _rows)."""
    return df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def heaviest(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The at most `clickloom.heavyKeys` keys that hold the most rows.

    So few rows come back that the result may always be broadcast, and of n heavy
    keys any key left out holds less than 1/n of the rows. Ties are cut by key
    order so that every evaluation picks the same keys.
    """
    spark = counts.sparkSession
    return (
        counts.filter(F.col("_rows") >= setting(spark, "clickloom.heavyRows"))
        .orderBy(F.desc("_rows"), *keys)
        .limit(setting(spark, "clickloom.heavyKeys"))
        .select(*keys, _salt_count(spark).alias(_SALTS))
    )


def _salt_count(spark: SparkSession) -> Column:
    least = setting(spark, "clickloom.salts")
    wanted = F.ceil(F.col("_rows") / F.lit(setting(spark, "clickloom.heavyRows")))
    return F.least(F.greatest(wanted, F.lit(least)), F.lit(least * SALT_GROWTH)).cast("int")


def heavy_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return heaviest(key_counts(df, keys), keys)


def mark_heavy(df: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """Add `_salts`, NULL for other keys; `heavy` has a proven row bound (see `heaviest`)."""
    return df.join(F.broadcast(heavy), keys, "left")


def salt_rows(df: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """Give rows of heavy keys one of their salts, all others 0.

    The salt hashes the whole row plus the task's partition number: identical
    copies spread too, and a task that runs again gives every row the same salt.
    Rows with a NULL key match nothing; they are spread over all numbers.
    """
    hashed = [f.name for f in df.schema.fields if not _UNHASHABLE.search(f.dataType.simpleString())]
    spread = F.hash(*hashed, F.spark_partition_id())
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    marked = df.withColumn(_SALT, spread)
    marked = mark_heavy(marked, heavy, keys)
    own = F.when(no_key, F.col(_SALT)).when(
        F.col(_SALTS).isNotNull(), F.pmod(_SALT, _SALTS)
    )
    return marked.withColumn(_SALT, F.coalesce(own, F.lit(0)).cast("int")).drop(_SALTS)


def repeat_rows(df: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat the rows of heavy keys once per salt, all others once with salt 0."""
    marked = mark_heavy(df, heavy, keys)
    values = F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1)
    return marked.withColumn(_SALT, F.explode(values)).drop(_SALTS)


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    where: str | None = None,
    keep_salt: bool = False,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Equi-join `fact` with `lookup` on `keys`; `how` is inner, left, left_semi or left_anti.

    `where` may add a condition on `f.<fact column>` and `d.<lookup column>`.
    The sides must share no other column names. The result has the fact columns
    and, except for semi and anti joins, the further lookup columns. With
    `keep_salt` the salt stays, so a grouping by (keys, _salt, ...) needs no
    second shuffle. Heavy keys are those with the most fact rows, or, given
    `weights`, the ones with the largest `_rows` there.
    """
    extra = [c for c in lookup.columns if c not in keys]
    clash = set(extra) & set(fact.columns)
    if clash and how not in ("left_semi", "left_anti"):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    salted = not fact.isStreaming and not fits_broadcast(lookup)
    if salted:
        heavy = heaviest(key_counts(fact, keys) if weights is None else weights, keys)
        left, right = salt_rows(fact, heavy, keys), repeat_rows(lookup, heavy, keys)
        on = [*keys, _SALT]
    else:
        left, right, on = fact, lookup, keys
        if keep_salt:
            left = left.withColumn(_SALT, F.lit(0))
    condition: Column = F.lit(True)
    for name in on:
        condition = condition & (F.col(f"f.{name}") == F.col(f"d.{name}"))
    if where:
        condition = condition & F.expr(where)
    joined = left.alias("f").join(right.alias("d"), condition, how)
    columns = [F.col(f"f.{c}") for c in fact.columns]
    if keep_salt:
        columns.append(F.col(f"f.{_SALT}"))
    if how not in ("left_semi", "left_anti"):
        columns += [F.col(f"d.{c}") for c in extra]
    return joined.select(*columns)


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key, the one with the lowest `order`; combined before the shuffle."""
    picked = F.min_by(F.struct(*columns), F.col(order)).alias("_first")
    return df.groupBy(key).agg(picked).select(key, "_first.*")
