"""Operator 9: token counts of documents in flat token files without an index.

A token file is nothing but unsigned ids (16 bits wide where the tokenizer's vocabulary and the separator
fit, else 32), documents one after another, each closed by the separator id.  Spark's text sink writes it:
a document's ids are a record's raw bytes and the separator's bytes end records.  Beside them, in files of
the same names, stand the ``doc_id`` values in the same order, nine bytes each; nothing tells where a
document starts.  Token files are read as blocks of a fixed number of ids that pay no heed to documents.
Each block is searched for the separator in one vectorised step.  A prefix scan over the blocks of a file
then gives each block the number of documents and the last separator before it, which stitches documents
that cross blocks.

A task starts a new file each ``FILE_BYTES`` of ids, so a file has that size at most, and a document's more; files
are read whole, one at a time in a task.  Null text counts as empty (only the separator); repeated rows
are documents of their own; an empty table gives no rows; other columns are ignored.  The separator is
never an id of a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from reelframe.llm.shared import work_dir
from reelframe.llm.tokens import encoder
from reelframe.llm.words import chunks

#: Ids in a block, and bytes of ids after which a file ends.
BLOCK, FILE_BYTES = 1 << 16, 32 << 20
TOKENS, IDS = 0, 1
#: A stored ``doc_id``: whether there is one, and its value.
DOC_ID = np.dtype([("known", "u1"), ("id", "<i8")])


def id_type(tokenizer: str, separator: int) -> str:
    """Wide enough for every id of the vocabulary and for the separator."""
    largest = max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, separator)
    return "<u2" if largest < 1 << 16 else "<u4"


def streaming(tokenizer: str, width: str, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal = filled = 0
        for part, _, _ in chunks(batches):
            ids, counts = encoder(tokenizer, plain=True).encode([t or "" for t in part.column("text").to_pylist()])
            n, size = part.num_rows, np.dtype(width).itemsize
            docs = np.zeros(n, DOC_ID)
            docs["known"] = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            docs["id"] = part.column("doc_id").fill_null(0).to_numpy()
            ends = np.concatenate([np.cumsum(counts) * size, counts.sum() * size + np.arange(1, n + 1) * DOC_ID.itemsize])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int64))
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, offsets.buffers()[1], pa.py_buffer(ids.astype(width).tobytes() + docs.tobytes())])
            place = np.tile(np.arange(ordinal, ordinal + n), 2)
            # A document belongs to the file in whose span of bytes it starts.
            sizes = (counts + 1) * size
            starts = filled + np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([TOKENS, IDS], n), pa.int32()), pa.array(np.tile(starts // limit, 2), pa.int64()), pa.array(place), values.cast(pa.binary())], ["kind", "file", "ordinal", "value"])
            ordinal, filled = ordinal + n, filled + int(sizes.sum())

    return run


def write_stream(docs: DataFrame, tokenizer: str, separator: int, path: str) -> None:
    """Token files and their lists of ``doc_id``: pairs in folders by kind and by the number of the file in its task."""
    width = id_type(tokenizer, separator)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(streaming(tokenizer, width, FILE_BYTES), "kind int, file long, ordinal long, value binary").sortWithinPartitions("kind", "file", "ordinal")
    raw = rows.select("kind", "file", F.col("value").cast("string").alias("value"))
    end = np.array([separator], width).tobytes().decode("latin-1")
    raw.write.partitionBy("kind", "file").options(lineSep=end, encoding="ISO-8859-1").text(path)


def read_blocks(spark: SparkSession, path: str, kind: int, size: int) -> DataFrame:
    """(file, block, bytes): the files of one kind in blocks of ``size`` bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").contains(f"/kind={kind}/"))
    name = F.concat_ws("-", F.regexp_extract("path", r"/part-(\d+)-", 1), F.regexp_extract("path", r"/file=(\d+)/", 1))
    blocks = files.select(name.alias("file"), "content", F.explode(F.sequence(F.lit(0), ((F.length("content") - 1) / size).cast("int"))).alias("block"))
    return blocks.select("file", F.col("block").cast("long").alias("block"), F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("bytes"))


def searching(separator: int, width: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for blob in batch.column("bytes"):
                ids = np.frombuffer(blob.as_buffer(), width)
                found.append(np.flatnonzero(ids == separator))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

    return run


def scan(blocks: DataFrame, separator: int, width: str) -> DataFrame:
    """file, ordinal (documents of the file before it), start and n_tokens (without the separator) of each document."""
    hits = blocks.mapInArrow(searching(separator, width), "file string, block long, n_ids long, ends array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = hits.withColumn("base", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    base = base.withColumn("ordinal_base", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)))
    base = base.withColumn("own_last", F.col("base") + F.array_max("ends"))
    base = base.withColumn("last_end", F.coalesce(F.max("own_last").over(earlier), F.lit(-1)))
    each = base.select("file", "base", "ordinal_base", "last_end", "ends", F.posexplode("ends").alias("k", "end"))
    previous = F.when(F.col("k") == 0, F.col("last_end")).otherwise(F.col("base") + F.try_element_at("ends", F.col("k")))
    return each.select("file", (F.col("ordinal_base") + F.col("k")).alias("ordinal"), (previous + 1).alias("start"), (F.col("base") + F.col("end") - previous - 1).alias("n_tokens"))


def naming(record: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, blob in zip(*batch.columns, strict=True):
                raw = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, record)[:, : DOC_ID.itemsize]
                docs = np.ascontiguousarray(raw).view(DOC_ID).ravel()
                ordinals = block.as_py() * BLOCK + np.arange(len(docs))
                yield pa.RecordBatch.from_arrays([pa.array([file.as_py()] * len(docs)), pa.array(ordinals), pa.array(docs["id"], mask=docs["known"] == 0)], ["file", "ordinal", "doc_id"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, separator: int, block: int = BLOCK) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens) of each document, counted in the files."""
    spark, path = docs.sparkSession, work_dir(docs.sparkSession)
    write_stream(docs, tokenizer, separator, path)
    width = id_type(tokenizer, separator)
    size = np.dtype(width).itemsize
    counted = scan(read_blocks(spark, path, TOKENS, block * size), separator, width)
    record = DOC_ID.itemsize + size
    names = read_blocks(spark, path, IDS, BLOCK * record).mapInArrow(naming(record), "file string, ordinal long, doc_id long")
    return names.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
