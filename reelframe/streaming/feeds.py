"""Stored events as streams in order of time, fed by a bounded number of ranges (SC12).

What has a watermark needs events in order of time from batch to batch, whatever files they lie in.  A table of up to
``RANGE_ROWS`` rows is one batch, in which order doesn't matter.  A longer one is dealt once into ranges of time, at
most ``MOST_RANGES``; each range is a folder that is moved into the place which the stream watches, and the query
drains it before the next one comes.  Nothing is done by file, and a range is as parallel as its files are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from reelframe.sources.workspace import shared_path

RANGE_ROWS, MOST_RANGES = 1 << 26, 64


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """SC12: the events table as a stream of files, with an event time."""
    schema = spark.read.parquet(path).schema
    # As a pattern, for a plain path would have to be a folder.
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("event_ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_id", "seq")


PARTITIONS, STATE_PARTS = "spark.sql.shuffle.partitions", 4
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(writer: DataStreamWriter, rocksdb: bool = False) -> None:
    """Runs a query until it has read all that there is; stateful processors need ``rocksdb``.

    Each partition of their state is a store and a Python worker in every batch, however few its keys are, so there are at most
    ``STATE_PARTS`` a core.
    """
    conf = writer._spark.conf
    own = {}
    if rocksdb:
        parts = min(int(conf.get(PARTITIONS)), STATE_PARTS * writer._spark.sparkContext.defaultParallelism)
        own = {PROVIDER: ROCKSDB, PARTITIONS: str(parts)}
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


class OrderedEvents:
    """The columns ``ts``, ``event_id`` and ``columns`` of a stored events table, fed in order of ``ts``."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str]) -> None:
        self.spark, self.columns = spark, ["ts", "event_id", *columns]
        events = spark.read.parquet(path).select(*self.columns)
        self.schema = events.schema
        n_ranges = min(MOST_RANGES, -(-events.count() // RANGE_ROWS))
        self.staged = None
        if n_ranges <= 1:
            self.place = f"{path[:-1]}[{path[-1]}]"
            return
        self.place, self.staged = shared_path(spark, "feed"), shared_path(spark, "ranges")
        # A few numbers come to the driver; events of equal time fall in one range.
        cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).approxQuantile("at", [k / n_ranges for k in range(1, n_ranges)], 0.2 / n_ranges)
        at = F.unix_micros(F.col("ts").cast("timestamp"))
        number = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c <= at))
        events.withColumn("part", F.coalesce(number, F.lit(0))).repartition("part", F.pmod(F.xxhash64("event_id"), F.lit(32))).write.partitionBy("part").parquet(self.staged)

    def stream(self) -> DataFrame:
        rows = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.place)
        return rows.withColumn("event_ts", F.col("ts").cast("timestamp")).withColumnRenamed("event_id", "seq")

    def feed(self, query: Callable[[DataFrame], DataStreamWriter], rocksdb: bool = False) -> None:
        """Runs ``query`` over the stream, range after range; it must go on from its own checkpoint."""
        if self.staged is None:
            drained(query(self.stream()), rocksdb)
            return
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        store = path(self.staged).getFileSystem(self.spark._jsc.hadoopConfiguration())
        store.mkdirs(path(self.place))
        for k in range(MOST_RANGES):
            folder = path(f"{self.staged}/part={k}")
            if store.exists(folder):
                store.rename(folder, path(f"{self.place}/range-{k:03}"))
                drained(query(self.stream()), rocksdb)
