"""Running values over an order without a task that sees all of a group.

Rows are dealt by ranges of group and order; each range is summed up by itself, and what comes before a range is a
summary of the earlier ranges, of which there is one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.sources.workspace import shared_path

#: What is kept of a range, how ranges are put together, and how a range's own value joins what came before it.
SUM, LAST, LEAST = "sum", "last", "least"


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` in a written table with their ``block``: no row of a block comes before one of an earlier block."""
    path = shared_path(rows.sparkSession, "ranged")
    rows.repartitionByRange(*order).withColumn("block", F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def running(rows: DataFrame, group: list[str], order: list[str], values: dict[str, str], kind: str, reverse: bool = False) -> DataFrame:
    """``rows`` with the sum, last known or least of columns of their group up to and including each row.

    ``values`` names the new columns and says of which ones they are; ``reverse`` goes from the end of the order to its
    start.  ``order`` must be unique within a group; nulls come first.
    """
    dealt = ranged(rows, *group, *order)
    place = F.struct(*order)

    def summary(c: str) -> Column:
        known = lambda x: F.when(F.col(c).isNotNull(), x)
        return {SUM: F.sum(c), LEAST: F.min(c), LAST: (F.min_by if reverse else F.max_by)(known(F.col(c)), known(place))}[kind]

    blocks = F.desc("block") if reverse else F.asc("block")
    before = Window.partitionBy(*group).orderBy(blocks).rowsBetween(Window.unboundedPreceding, -1)
    over = {SUM: F.sum, LEAST: F.min, LAST: lambda c: F.last(c, ignorenulls=True)}[kind]
    parts = dealt.groupBy("block", *group).agg(*[summary(c).alias(f"_part_{name}") for name, c in values.items()])
    keys = [F.col(g).alias(f"_group_{k}") for k, g in enumerate(group)]
    parts = parts.select(F.col("block").alias("_block"), *keys, *[over(f"_part_{name}").over(before).alias(f"_base_{name}") for name in values])
    own = Window.partitionBy("block", *group).orderBy(*[F.desc(c) if reverse else F.asc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("block") == F.col("_block")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group_{k}"))
    joined = dealt.withColumns({f"_own_{name}": over(c).over(own) for name, c in values.items()}).join(parts, same)

    def found(name: str) -> Column:
        mine, base = f"_own_{name}", f"_base_{name}"
        return {SUM: F.coalesce(mine, F.lit(0)) + F.coalesce(base, F.lit(0)), LEAST: F.least(mine, base), LAST: F.coalesce(mine, base)}[kind].alias(name)

    return joined.select(*rows.columns, *map(found, values))


def running_sum(rows: DataFrame, order: list[str], step: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``step`` up to and including each row, as ``total``; ``order`` must be unique, nulls come first."""
    return running(rows, [], order, {total: step}, SUM)
