"""Tables stored in buckets of a key, of which joins on it move no row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.plans.skew import heavy_keys, repeat_rows, salt_rows

_SALT = "_salt"


@dataclass(frozen=True)
class Buckets:
    """A table stored in `count` buckets of (`key`, salt), sorted by them.

    Rows of a heavy key are dealt over several salts, so they lie in several buckets; the
    heavy keys, at most `clickloom.heavyKeys`, and how many salts each has are stored
    beside the table. What is joined to it is repeated once per salt of such a key.
    """

    spark: SparkSession
    name: str
    key: str

    def write(self, rows: DataFrame, folder: str, count: int) -> Buckets:
        """Store `rows` under `folder` as the catalog tables `name` and `name`_heavy."""
        heavy = heavy_keys(rows, [self.key])
        heavy.coalesce(1).write.mode("overwrite").option("path", f"{folder}/heavy").saveAsTable(
            f"{self.name}_heavy"
        )
        salted = salt_rows(rows, self.heavy(), [self.key]).repartition(count, self.key, _SALT)
        writer = salted.write.mode("overwrite").option("path", f"{folder}/rows")
        writer.bucketBy(count, self.key, _SALT).sortBy(self.key, _SALT).saveAsTable(self.name)
        return self

    def heavy(self) -> DataFrame:
        return self.spark.table(f"{self.name}_heavy")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name).drop(_SALT)

    def _repeated(self, keys: DataFrame) -> DataFrame:
        wanted = keys.select(self.key).dropna().distinct()
        return repeat_rows(wanted, self.heavy(), [self.key])

    def with_keys(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is one of `keys`."""
        joined = self.spark.table(self.name).join(
            self._repeated(keys), [self.key, _SALT], "left_semi"
        )
        return joined.drop(_SALT)

    def without_keys(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is none of `keys`, rows without a key among them."""
        joined = self.spark.table(self.name).join(
            self._repeated(keys), [self.key, _SALT], "left_anti"
        )
        return joined.drop(_SALT)

    def keys_in_use(self, keys: DataFrame) -> DataFrame:
        """The distinct `keys` that some row has."""
        kept = self.spark.table(self.name).select(self.key, _SALT)
        found = self._repeated(keys).join(kept, [self.key, _SALT], "left_semi")
        return found.select(F.col(self.key)).distinct()
