"""Places and small Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelframe.sources.workspace import shared_path


def work_dir(spark: SparkSession) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``)."""
    return shared_path(spark, "llm")


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], by: str, salts: int = 16) -> DataFrame:
    """Inner join of ``rows`` to ``few`` (one row per key), in ``salts`` parts by a hash of ``by``.

    Each part meets a copy of the row that it needs, so a key that holds a third of all rows is no task of
    its own.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    places = rows.select(*on, "_salt").distinct().join(few, on)
    return rows.join(places, [*on, "_salt"]).drop("_salt")


def text_digest(text: str = "text"):
    """128 bits and the length tell texts apart; computed in the JVM."""
    return F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 32)
