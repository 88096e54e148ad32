"""Reads of database tables in several partitions, with filters and columns pushed to the database (SC8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows that a partition should have, and how many partitions a read has at most.
PARTITION_ROWS, MOST = 1_000_000, 512


def read_table(spark: SparkSession, url: str, table: str, column: str, partitions: int | None = None, **options: str) -> DataFrame:
    """``table`` in partitions by ranges of ``column``, a number, date or timestamp.

    The database is asked once for the least and greatest value and the number of rows; null values of ``column`` are
    in the first partition.  Filters on the result and its columns go to the database with each partition's range.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    asked = reader.option("dbtable", f"(SELECT min({column}) AS low, max({column}) AS high, count(*) AS n FROM {table}) bounds").load()
    low, high, n = (asked.first()[k] for k in range(3))
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, pushDownPredicate="true", fetchsize="10000", **options)
    parts = partitions or min(MOST, max(1, -(-n // PARTITION_ROWS)))
    if low is None or parts == 1:
        return reader.load()
    return reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def write_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    """``rows`` into ``table``, which is made or added to; a connection per partition."""
    rows.write.format("jdbc").options(url=url, dbtable=table, batchsize="10000", **options).mode("append").save()
