"""Operator 8: token ids as ORC files, written in ascending ``doc_id`` order and read back.

Ids are ORC integer lists (run-length encoded per stripe), with row indexes and a Bloom filter on
``doc_id``; stripes can be read in parallel, and a filter on ``doc_id`` skips stripes and row groups by
their metadata.  A file holds about ``FILE_BYTES`` of text at most, however large the table is.  Rows without
a ``doc_id`` come first; rows that share one are ordered by their text.
Null text counts as empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reelframe.llm.shared import written, work_dir
from reelframe.llm.tokens import encoder
from reelframe.llm.words import chunks

OPTIONS = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}


#: Bytes of text in a file, at most and (where there are enough) at least.
FILE_BYTES, LEAST_BYTES = 256 << 20, 8 << 20


def encoding(tokenizer: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, position = encoder(tokenizer).encode, 0
        for part, _, _ in chunks(batches):
            ids, counts = encode([t or "" for t in part.column("text").to_pylist()])
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(np.int32)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.arange(position, position + len(ends))), lists], ["doc_id", "position", "ids"])
            position += len(ends)

    return run


def file_count(spark: SparkSession, size: int) -> int:
    """Files for ``size`` bytes of text: one per shuffle partition, unless they were too small or too large."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES))
    return max(1, parts, -(-size // FILE_BYTES))


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Sorts by range, so part files follow each other; a file is one range and is sorted within.

    Rows that are alike in all else are spread by a running number, so that no group of them fills one file.
    """
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"tie": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
    order = ["doc_id", "tie", "spread"]
    ordered = ordered.repartitionByRange(file_count(docs.sparkSession, size), *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(encoding(tokenizer, end_id), "doc_id long, position long, ids array<int>").write.options(**OPTIONS).orc(path)


def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
        offsets = lists.offsets.to_numpy().tolist()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("position"), batch.column("doc_id"), pa.array(counts), pa.array(crc, pa.int64())], ["part", "position", "doc_id", "n_tokens", "ids_crc32"])


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: where its ids start, how many there are, and their checksum."""
    stored = spark.read.schema("doc_id long, position long, ids array<int>").orc(path)
    stored = stored.select(F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long").alias("part"), "position", "doc_id", "ids")
    found = written(stored.mapInArrow(digests, "part long, position long, doc_id long, n_tokens long, ids_crc32 long"))
    # One row per file; files are few and of bounded size, so the scan over them is short.
    before = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("position")) - F.col("n_tokens")
    return found.withColumn("inside", inside).join(before, "part").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    path = work_dir(docs.sparkSession)
    write_orc(docs, path, tokenizer, end_id)
    return read_orc(docs.sparkSession, path)
