"""Event streams folded into tables (ST1-ST7, ST10-ST12); what needs timers is in ``sessions``.

Events carry ``event_ts`` and ``seq``; the greatest pair wins, so replays and reordering don't matter.
State grows with the keys, never with the events, and what a result reads doesn't grow with the batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from reelframe.operators.running import SUM, running
from reelframe.sources.workspace import shared_path
from reelframe.streaming.feeds import OrderedEvents, drained
from reelframe.streaming.state import KeyedTable

#: Idle time after which a session is closed, and how late an event may come.
IDLE, LATE = "120 seconds", "10 minutes"


def run_to_table(stream: DataFrame, *partitions: str) -> DataFrame:
    """ST11's sink: all that the stream has now, appended to a table in the shared folder."""
    path, checkpoint = (shared_path(stream.sparkSession, n) for n in ("sink", "stream"))
    drained(_appending(stream, path, checkpoint, *partitions))
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def _appending(stream: DataFrame, path: str, checkpoint: str, *partitions: str):
    return stream.writeStream.format("parquet").partitionBy(*partitions).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def feed_to_table(events: OrderedEvents, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``made`` makes of the stream of ``events``, in order of time, as a table."""
    path, checkpoint = (shared_path(events.spark, n) for n in ("sink", "stream"))
    events.feed(lambda stream: _appending(made(stream), path, checkpoint))
    return events.spark.read.schema(made(events.stream()).schema).parquet(path)


def newest(rows: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The last event of each key, with the last known value of the fields in ``keep`` (ST1, ST3)."""
    order = F.struct("event_ts", "seq")
    fields = [c for c in rows.columns if c not in (key, *keep)]
    kept = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in keep]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("row"), *kept).select(key, *[f"row.{c}" for c in fields], *keep)


def fold_latest(stream: DataFrame, key: str, keep: list[str], name: str = "state", location: str | None = None, snapshot: Callable[[], DataFrame] | None = None, every: int | None = None) -> DataFrame:
    """ST1-ST3, ST10, ST12: the latest state of each key; an event of kind ``removed`` is a tombstone that older events can't undo.

    The stream's state store holds the fold, and each batch writes only the keys that it changed, so a batch
    costs what it brings; see ``state`` for what a result reads.  With a ``location`` the next call goes on where the
    last one ended.  ``snapshot`` is read anew by each batch and adds its columns; changes of keys that even then
    it doesn't hold are left out (ST1).  Tombstones stay for good; ``sessions.fold_with_ends`` ends them.
    """
    spark = stream.sparkSession
    root = location or shared_path(spark, name)
    folded, table = newest(stream, key, keep), KeyedTable(spark, f"{root}/table", key, every)

    def joined(rows: DataFrame) -> DataFrame:
        return rows if snapshot is None else rows.join(snapshot(), key)

    drained(folded.writeStream.outputMode("update").foreachBatch(lambda batch, number: table.put(joined(batch), number)).option("checkpointLocation", f"{root}/checkpoint"))
    found = table.rows()
    found = joined(spark.createDataFrame([], folded.schema)) if found is None else found
    return found.where("kind <> 'removed'")


def completed_once(stream: DataFrame, key: str) -> DataFrame:
    """ST4: the first event of a key that says it is complete, within the watermark.

    ``finished`` alone isn't believed: it is true of nothing selected too, so there must be bytes.
    """
    done = stream.withWatermark("event_ts", LATE).where("finished AND total > 0 AND done >= total")
    return done.dropDuplicatesWithinWatermark([key])


def idle_sessions(stream: DataFrame, key: str) -> DataFrame:
    """ST9: sessions that have been idle long enough to be closed."""
    grouped = stream.withWatermark("event_ts", LATE).groupBy(key, F.session_window("event_ts", IDLE).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def stats(stream: DataFrame, keys: DataFrame, fields: list[str], width: str = "2 seconds") -> DataFrame:
    """ST6: per tumbling window the last progress, total, speed, peers and finished (``fields``) of wanted keys (a table)."""
    kept = stream.join(keys, "info_hash", "left_semi").withWatermark("event_ts", LATE)
    last = F.max_by(F.struct(*fields), F.struct("event_ts", "seq")).alias("r")
    return kept.groupBy("info_hash", F.window("event_ts", width).alias("w")).agg(last).select("info_hash", F.col("w.start").alias("started"), "r.*")


def ticks(stream: DataFrame, keys: DataFrame, width: str = "2 seconds") -> DataFrame:
    """ST6 in short: how many events wanted keys (a table) have per tumbling window, and the largest value."""
    kept = stream.join(keys, "user_id", "left_semi").withWatermark("event_ts", LATE)
    return kept.groupBy("user_id", F.window("event_ts", width).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("value")).select("user_id", F.col("w.start").alias("started"), "n", "value")


def waiting(rows: DataFrame) -> DataFrame:
    """ST7: nothing done yet."""
    return rows.withColumn("waiting", F.coalesce(F.col("done"), F.lit(0)) <= 0)


def route(stream: DataFrame, prefix: str) -> DataFrame:
    """ST11: messages (topic, seq, payload) of the topics that start with ``prefix``, with their payload as it came, a partition per topic.

    The payload is a variant: its fields can be read by path, and it needs no schema.
    """
    kept = stream.where(F.col("topic").startswith(prefix))
    return run_to_table(kept.select("topic", "seq", F.try_parse_json("payload").alias("payload")), "topic")


def failure_alarm(events: OrderedEvents, made: Callable[[DataFrame], DataFrame], limit: int) -> DataFrame:
    """ST5: (key, seq) each time a key reaches ``limit`` failures in a row; ``made`` gives key, event_ts, seq and failed.

    A batch is summed by ranges of (key, time), so a key of any number of events is many tasks; between batches each key
    keeps the length of its last run.
    """
    spark, root = events.spark, shared_path(events.spark, "alarm")
    runs = KeyedTable(spark, f"{root}/runs", "key")

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("key", "event_ts", "seq", F.col("failed").cast("long").alias("bad"), (1 - F.col("failed").cast("long")).alias("good"))
        order = ["event_ts", "seq"]
        islands = running(rows, ["key"], order, {"island": "good"}, SUM)
        placed = running(islands, ["key", "island"], order, {"n": "bad"}, SUM)
        before = runs.rows(number - 1)
        placed = placed.withColumn("run", F.lit(None).cast("long")) if before is None else placed.join(before, "key", "left")
        # A run that is open since the batches before goes on until the first success.
        placed = placed.withColumn("n", F.col("n") + F.when(F.col("island") == 0, F.coalesce("run", F.lit(0))).otherwise(0)).drop("run")
        placed.write.mode("overwrite").parquet(f"{root}/placed/batch={number}")
        placed = spark.read.parquet(f"{root}/placed/batch={number}")
        placed.where((F.col("bad") == 1) & (F.col("n") == limit)).select("key", "seq").write.mode("overwrite").parquet(f"{root}/alarms/batch={number}")
        last = F.max_by(F.when(F.col("bad") == 1, F.col("n")).otherwise(0), F.struct(*order))
        runs.put(placed.groupBy("key").agg(last.cast("long").alias("run")), number)

    events.feed(lambda stream: made(stream).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint"))
    empty = made(events.stream()).select("key", "seq").schema
    return spark.read.schema(empty).parquet(f"{root}/alarms").select("key", "seq") if runs.numbers("changes") else spark.createDataFrame([], empty)
