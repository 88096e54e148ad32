"""File sources and sinks (SC2, SC7, SC9, SC11): listings, subtitle corpora, storage, WebVTT."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


#: For writes of very many files: each task moves its own into place, where else the driver moves all one by one at the end.
EACH_TASK_MOVES = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def subtitle_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, content)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def storage_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of regular files below ``path``; their content is never read, and empty ones are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(path)
    return rows.select("path", "length", "modificationTime")


#: Files that turn out to be damaged or gone while they are read are left out.
TOLERANT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def listing_sources(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """SC2: documents of all sources as (source_idx, source_url, json), and what each source gave.

    A source may be missing, and its files may be damaged or vanish while they are read; the others still give
    their rows.  The report is (source_idx, source_url, n_files, n_read), of which files that were found and read;
    it counts files by their metadata, and is true when it is run.
    """
    found, listed = [], []
    source = lambda k, path: [F.lit(k).alias("source_idx"), F.lit(path).alias("source_url")]
    for k, path in enumerate(paths):
        try:
            rows = spark.read.options(**TOLERANT).text(path, wholetext=True)
            files = spark.read.options(**TOLERANT).format("binaryFile").load(path)
        except AnalysisException:
            continue
        found.append(rows.select(*source(k, path), F.input_file_name().alias("file"), F.col("value").alias("json")))
        listed.append(files.select(*source(k, path), F.lit(1).alias("there")))
    documents = reduce(DataFrame.unionByName, found, spark.createDataFrame([], "source_idx int, source_url string, file string, json string"))
    there = reduce(DataFrame.unionByName, listed, spark.createDataFrame([], "source_idx int, source_url string, there int"))
    asked = spark.createDataFrame(list(enumerate(paths)), "source_idx int, source_url string")
    read = documents.groupBy("source_idx").agg(F.count("*").alias("n_read"))
    files = there.groupBy("source_idx").agg(F.count("*").alias("n_files"))
    report = asked.join(files, "source_idx", "left").join(read, "source_idx", "left").na.fill(0, ["n_files", "n_read"])
    return documents.drop("file"), report.select("source_idx", "source_url", "n_files", "n_read")


def write_vtt(lines: DataFrame, path: str) -> None:
    """SC11: a folder per track (a number) from ``operators.subtitles.vtt_lines``.

    Pieces are dealt by ranges of (track_id, idx): a short track is one file, a long one several whose names are in order.
    """
    dealt = lines.repartitionByRange("track_id", "idx").sortWithinPartitions("track_id", "idx")
    dealt.select("track_id", "value").write.partitionBy("track_id").text(path)
