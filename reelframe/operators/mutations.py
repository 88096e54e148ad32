"""Batch merges: new snapshots of tables that Parquet can't change in place (DM1-DM11, SC10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.sources.workspace import shared_path

STATES = ["queued", "downloading", "transcoding", "paused", "completed", "failed", "cancelled"]
# Actions, the states that they leave alone, and the state they lead to; for downloads and for jobs.
DOWNLOAD_ACTIONS = {"pause": (["completed", "failed"], "paused"), "queue": (["completed", "failed"], "queued"), "cancel": (["completed", "failed"], "cancelled"), "fail": (["cancelled", "paused"], "failed"), "complete": ([], "completed")}
JOB_ACTIONS = {
    "pause": (["downloading", "paused", "completed", "failed", "cancelled"], "paused"),
    "queue": (["queued", "downloading", "transcoding", "completed", "failed", "cancelled"], "queued"),
    "cancel": (["completed", "failed"], "cancelled"),
    "fail": (["cancelled"], "failed"),
    "complete": (["queued", "downloading", "paused", "completed", "failed", "cancelled"], "completed"),
    "claim": (["downloading", "transcoding", "paused", "completed", "failed", "cancelled"], "transcoding"),
    "stop": (["queued", "downloading", "paused", "completed", "failed", "cancelled"], "cancelled"),
    "abort": (["queued", "cancelled", "paused"], "failed"),
}


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """DM1, DM3, DM6: the newest change of each key, else the base row; one pre-aggregated shuffle, no join."""
    columns = base.columns
    rank = lambda df, new: df.select(*keys, F.struct(F.lit(new).alias("new"), F.col(order).alias("at") if new else F.lit(None).cast(changes.schema[order].dataType).alias("at")).alias("o"), F.struct(*columns).alias("row"))
    both = rank(base, 0).unionByName(rank(changes, 1))
    return both.groupBy(*keys).agg(F.max_by("row", "o").alias("row")).select("row.*")


def insert_absent(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """DM2, SC10: rows whose key the base lacks are added."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def insert_with_ids(base: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DM4: new rows get ids above the base's; known keys keep theirs, and their status.

    Ids follow a range sort: each partition numbers its own rows above the counts before it.
    """
    spark, path = base.sparkSession, shared_path(base.sparkSession, "new-rows")
    new = rows.join(base.select(*keys), keys, "left_anti").repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once, so that counts and rows come from the same partitions even if a task is run again.
    new.withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33)).write.parquet(path)
    new = spark.read.parquet(path)
    # One row per partition.
    skip = F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = new.groupBy("_p").agg(F.count("*").alias("c")).select("_p", skip.alias("skip"))
    top = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    numbered = new.join(before, "_p").withColumn("id", F.lit(top) + F.col("skip") + F.col("_n") + 1)
    return base.unionByName(numbered.select(*base.columns))


def reset_upsert(base: DataFrame, rows: DataFrame, key: str, keep: list[str], fresh: dict[str, Column]) -> DataFrame:
    """DM5: named rows start anew unless their state is in ``keep``; unknown keys are added."""
    asked = rows.select(key).distinct().withColumn("_asked", F.lit(True))
    joined = base.join(asked, key, "full_outer")
    restart = F.col("_asked") & (F.col("status").isNull() | ~F.col("status").isin(keep))
    return joined.select(key, *[F.when(restart, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in base.columns if c != key])


def delete_cascade(gone: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """DM7: children of deleted parents go."""
    return child.join(gone.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def delete_set_null(gone: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """DM7: children of deleted parents lose the reference."""
    marked = gone.select(F.col(parent_key).alias(child_key), F.lit(True).alias("_gone")).distinct()
    joined = child.join(marked, child_key, "left")
    return joined.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == child_key else F.col(c) for c in child.columns])


def transition_rows(actions: dict[str, tuple[list[str], str]]) -> list[tuple[str, str, str]]:
    """(action, from, to) for every state that the action applies to."""
    return [(action, state, to) for action, (alone, to) in actions.items() for state in STATES if state not in alone]


def transitions(rows: DataFrame, asked: DataFrame, actions: dict[str, tuple[list[str], str]]) -> DataFrame:
    """DM8: each asked action where its state allows it; ``applied`` tells which did. The table has a row for each action and state at most."""
    table = rows.sparkSession.createDataFrame(transition_rows(actions), "action string, status string, next string")
    joined = rows.join(asked, "id", "left").join(F.broadcast(table), ["action", "status"], "left")
    return joined.select("id", F.coalesce("next", "status").alias("status"), F.col("next").isNotNull().alias("applied"))


def recovered_downloads(rows: DataFrame) -> DataFrame:
    """DM9: downloads that were running queue again, and keep what they have."""
    return rows.withColumn("status", F.when(F.col("status") == "downloading", "queued").otherwise(F.col("status")))


def recovered_jobs(rows: DataFrame, progress: str) -> DataFrame:
    """DM9: jobs that were running queue again; these and paused ones start from 0, all others are as they were."""
    again = F.col("status").isin("transcoding", "paused")
    return rows.withColumns({"status": F.when(F.col("status") == "transcoding", "queued").otherwise(F.col("status")), progress: F.when(again, 0).otherwise(F.col(progress)).cast("bigint")})


def restarted(rows: DataFrame) -> DataFrame:
    """DM10: paused, cancelled and failed rows queue again without their ``error``; what they have stays."""
    again = F.col("status").isin("paused", "cancelled", "failed")
    return rows.withColumns({"status": F.when(again, "queued").otherwise(F.col("status")), "error": F.when(~F.coalesce(again, F.lit(False)), F.col("error"))})


def collection_updates(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """DM11: rows with a new ``name`` and ``visible`` where asked; a null in ``asked`` leaves the field.

    Any row may be renamed, hidden and shown; only deletes are refused to system rows.
    """
    wanted = asked.groupBy(key).agg(F.max("name").alias("_name"), F.max("visible").alias("_visible"))
    joined = rows.join(wanted, key, "left")
    return joined.withColumns({"name": F.coalesce("_name", "name"), "visible": F.coalesce("_visible", "visible")}).select(*rows.columns)


def protected_delete(rows: DataFrame, asked: DataFrame, key: str, protected: Column) -> tuple[DataFrame, DataFrame]:
    """DM11: (what stays, what was asked but refused)."""
    named = asked.select(key).distinct()
    refused = rows.join(named, key, "left_semi").where(protected)
    stays = rows.join(named.withColumn("_asked", F.lit(True)), key, "left").where(F.col("_asked").isNull() | protected).drop("_asked")
    return stays, refused
