"""Tables that streams keep: changes by batch, folded from time to time into a snapshot.

A batch writes only what it changed.  Every ``EVERY`` batches the newest snapshot and the changes since become a
new snapshot; it is written aside and committed by one rename, so there is always a whole one.  A result reads the
newest snapshot and the changes after it: at most ``EVERY`` batches, however many there were.  A batch that is run
again after a failure writes the same folder again, and its snapshot counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

EVERY = 8


class KeyedTable:
    """The newest row of each key, by batch; rows of one batch have each key once.

    Rows for which ``dead`` (SQL) is true hide older rows of their key, and are left out of snapshots.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, every: int | None = None, dead: str | None = None) -> None:
        self.spark, self.root, self.key, self.every, self.dead = spark, root.rstrip("/"), key, every or EVERY, dead
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.store = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, kind: str) -> list[int]:
        """The numbers of the folders of ``changes`` or of ``snapshots``; one listing."""
        place = self.path(f"{self.root}/{kind}")
        if not self.store.exists(place):
            return []
        names = [f.getPath().getName() for f in self.store.listStatus(place)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def put(self, rows: DataFrame, batch: int) -> None:
        """What ``batch`` changed, all columns of its keys; then a snapshot, if one is due."""
        rows.write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch}")
        done = self.numbers("snapshots")
        if batch - (done[-1] if done else -1) >= self.every:
            self.fold(batch, done)

    def fold(self, batch: int, done: list[int]) -> None:
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        rows = self.rows(batch)
        rows = rows if self.dead is None else rows.where(f"NOT coalesce({self.dead}, false)")
        rows.write.parquet(aside)
        target = self.path(f"{self.root}/snapshots/batch={batch}")
        self.store.mkdirs(target.getParent())
        if self.store.exists(target) or not self.store.rename(self.path(aside), target):
            self.store.delete(self.path(aside), True)
        # Readers of the snapshot before may still be at work; what came before that one goes.
        if done:
            for kind in ("changes", "snapshots"):
                for n in self.numbers(kind):
                    if n < done[-1] or kind == "changes" and n == done[-1]:
                        self.store.delete(self.path(f"{self.root}/{kind}/batch={n}"), True)

    def folders(self, upto: int | None = None) -> list[str]:
        """The folders that make the table as of a batch (the newest, by default)."""
        known = lambda n: upto is None or n <= upto
        done = [n for n in self.numbers("snapshots") if known(n)]
        base = done[-1] if done else -1
        changed = [f"{self.root}/changes/batch={n}" for n in self.numbers("changes") if n > base and known(n)]
        return [*[f"{self.root}/snapshots/batch={base}" for _ in done[-1:]], *changed]

    def rows(self, upto: int | None = None) -> DataFrame | None:
        """The newest row of each key, as of a batch; none if no batch was written."""
        folders = self.folders(upto)
        if not folders:
            return None
        number = F.regexp_extract(F.input_file_name(), r"/batch=(\d+)/", 1).cast("long")
        found = self.spark.read.schema(self.spark.read.parquet(folders[-1]).schema).parquet(*folders)
        if len(folders) == 1:
            return found
        last = found.withColumn("_batch", number).groupBy(self.key).agg(F.max_by(F.struct(*[c for c in found.columns if c != self.key]), "_batch").alias("_row"))
        return last.select(self.key, "_row.*").select(*found.columns)
