"""Tables in buckets of their key, so that a merge rewrites only the buckets that it changes (DM1, DM3).

A bucket is a folder; a row's bucket is a hash of its key.  A merge reads the buckets that its changes fall in, by
partition pruning, and replaces these folders alone (dynamic partition overwrite); all other files stay as they are.
What a merge makes is written aside first, so it never overwrites what it still reads; a merge that is run again after a
failure gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelframe.operators.mutations import upsert
from reelframe.sources.workspace import stored

BUCKET = "bucket"


class BucketedTable:
    """A Parquet table at ``path`` whose rows are told apart by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 256) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def write(self, rows: DataFrame) -> None:
        """Replaces the buckets that ``rows`` (with their bucket) fall in; each is one task's, split where it is large."""
        dealt = rows.repartition(BUCKET).sortWithinPartitions(BUCKET, *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self.columns, self.schema = rows.columns, self.placed(rows).schema
        self.write(self.placed(rows))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        rows = rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))
        return rows.select(*self.columns)

    def touched(self, changes: DataFrame) -> list[int]:
        """The numbers of the buckets that changes fall in: at most ``buckets`` of them."""
        return sorted(r[0] for r in self.placed(changes).select(BUCKET).distinct().collect())

    def merge(self, changes: DataFrame, order: str) -> list[int]:
        """The newest change of each key, by ``order``, else the row that was there; returns the buckets that were rewritten."""
        touched = self.touched(changes)
        if touched:
            self.write(stored(self.placed(upsert(self.read(touched), changes.select(*self.columns), self.keys, order)), "merge"))
        return touched
