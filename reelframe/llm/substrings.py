"""Operator 6: removing passages that an earlier document has, with a count-min prefilter.

A window is 50 consecutive words of one document.  Its *anchor* is the least hash among the runs of 16
words inside it; equal windows have equal anchors, and neighbours mostly share one, so about one hash
in eighteen words stands for all windows.

0. A text that a document with a smaller ``doc_id`` has whole is a copy: all its windows start there, so
   all its words go (from 50 words on) and its windows needn't be counted.  A membership filter of
   bounded size over the first documents of each text lets tasks leave copies out before they send
   anything; a copy that slips through changes nothing.
1. Each task counts the documents of its anchors in a partition sketch (two cells per anchor, counts
   stop at two).  Partition sketches are merged by segment, in two steps.  The sum overestimates how
   many documents have an anchor, hence a window, and never underestimates it.
2. The merged sketch, one bit per cell, has a bounded size (``MAX_CELLS`` / 8 bytes) and goes to every
   task.  Windows whose anchor it estimates in two documents or more are grouped exactly, by 128 bits
   of hash, which gives the smallest ``doc_id`` each starts in.  Beyond that bound a cell holds more
   anchors and more windows pass to the exact grouping; none is ever lost.
3. Words covered by a window that starts in a document with a smaller ``doc_id`` go.

Null text has no words.  Rows without ``doc_id`` neither remove nor lose anything, rows that share a
``doc_id`` don't remove each other's words.  Texts of under 50 words stay whole.  Extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from reelframe.llm.members import hash_of, member_bits, pass_members
from reelframe.llm.shared import text_digest, written
from reelframe.llm.words import BASE_A, BASE_B, NOT_SPACE, U, chunks, find, mix, sliding_min, windows, word_hashes

WINDOW, RUN = 50, 16
#: The sketch has this many cells per byte of text, between these bounds; a segment has 2 ** 20.
CELLS_PER_BYTE, MIN_CELLS, MAX_CELLS, SEGMENT_BITS = 1 / 8, 1 << 20, 1 << 30, 20
#: Anchors that a task gathers before it sends its counts.
FLUSH = 2_000_000
#: Partition sketches merged together in the first step.
SALTS = 32


def windowed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with their texts; which words start a window, and each window's anchor."""
    inside = NOT_SPACE[data]
    starts, ends, text = find(data, offsets, inside)
    hashes = word_hashes(data, inside, starts, ends)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return hashes, text, np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    _, runs_at = windows(hashes, np.zeros(len(hashes), np.int8), RUN)
    return hashes, text, at, sliding_min(runs_at, WINDOW - RUN + 1)[at]


def cells_of(anchors: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U(cells - 1)
    return (anchors & mask).astype(np.int64), (mix(anchors) & mask).astype(np.int64)


def sketching(cells: int, members):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(members.value, U)
        batches = (pass_members(b, "hash", words) for b in batches)
        kept: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            segment = found >> SEGMENT_BITS
            numbers = np.unique(segment)
            bounds = np.append(np.searchsorted(segment, numbers), len(found)).tolist()
            local = (found & ((1 << SEGMENT_BITS) - 1)).astype("<u4")
            once = [local[a:b][counts[a:b] == 1].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            more = [local[a:b][counts[a:b] > 1].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["segment", "once", "more"])

        for _, data, offsets in chunks(batches):
            _, text, at, anchors = windowed(data, offsets)
            if not len(at):
                continue
            owner = text[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
            anchors, owner = anchors[new], owner[new]
            order = np.lexsort((anchors, owner))
            anchors, owner = anchors[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
            kept += cells_of(anchors[new], cells)
            if sum(map(len, kept)) > 2 * FLUSH:
                yield send()
        if kept:
            yield send()

    return run


def merging(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums the partition sketches of one segment; counts stop at two."""
    count = np.zeros(1 << SEGMENT_BITS, np.uint8)
    for once, more in zip(rows["once"], rows["more"], strict=True):
        count[np.frombuffer(once, "<u4")] += 1
        count[np.frombuffer(more, "<u4")] = 2
        np.minimum(count, 2, out=count)
    sparse = lambda level: np.flatnonzero(count == level).astype("<u4").tobytes()
    return pd.DataFrame({"segment": [int(keys[0])], "once": [sparse(1)], "more": [sparse(2)]})


def merged_sketch(docs: DataFrame, cells: int, members) -> np.ndarray:
    """One bit per cell: whether two documents or more are estimated there.  At most MAX_CELLS / 8 bytes."""
    parts = docs.select("hash", "text").mapInArrow(sketching(cells, members), "segment long, once binary, more binary")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("once", "more"), F.lit(SALTS)))
    some = parts.groupBy("segment", "salt").applyInPandas(merging, "segment long, once binary, more binary")
    whole = some.groupBy("segment").applyInPandas(merging, "segment long, once binary, more binary")
    bits = np.zeros(cells // 8, np.uint8)
    for row in whole.select("segment", "more").toLocalIterator():
        base = (row.segment << SEGMENT_BITS) // 8
        flags = np.zeros(1 << SEGMENT_BITS, bool)
        flags[np.frombuffer(row.more, "<u4")] = True
        packed = np.packbits(flags, bitorder="little")
        bits[base : base + len(packed)] = packed
    return bits


def passing(sketch, cells: int, members):
    """Windows that the sketch estimates in two documents or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, first_ids = np.frombuffer(sketch.value, np.uint8), np.frombuffer(members.value, U)
        for part, data, offsets in chunks(pass_members(b, "hash", first_ids) for b in batches):
            hashes, text, at, anchors = windowed(data, offsets)
            if not len(at):
                continue
            hit = np.ones(len(at), bool)
            for cell in cells_of(anchors, cells):
                hit &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            if not hit.any():
                continue
            at = at[hit]
            words = np.bincount(text, minlength=part.num_rows)
            first = np.cumsum(words) - words
            _, low = windows(hashes, text, WINDOW, BASE_A)
            _, high = windows(hashes, text, WINDOW, BASE_B)
            owner = pa.array(text[at])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(owner), part.column("row_hash").take(owner), pa.array((at - first[text[at]]).astype(np.int32)), pa.array(low[hit].view(np.int64)), pa.array(high[hit].view(np.int64))],
                ["doc_id", "row_hash", "start", "low", "high"],
            )

    return run


def removing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what is left of each text, and the digest of its kept words."""
    for part, data, offsets in chunks(batches):
        n = part.num_rows
        inside = NOT_SPACE[data]
        starts, ends, text = find(data, offsets, inside)
        words = np.bincount(text, minlength=n)
        first = np.cumsum(words) - words
        lists = part.column("starts")
        keep = np.ones(len(starts), bool)
        if lists.null_count < n:
            filled = lists.flatten().to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.repeat(first, lengths) + filled
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            keep = np.cumsum(cover)[:-1] == 0
            copies = pc.fill_null(part.column("copy"), False).to_numpy(zero_copy_only=False) & (words >= WINDOW)
            keep &= ~copies[text]
        removed = words - np.bincount(text[keep], minlength=n)
        s, e, t = starts[keep], ends[keep], text[keep]
        sizes = e - s + 1
        out = np.cumsum(sizes) - sizes
        body = np.append(data, np.uint8(32))[np.repeat(s - out, sizes) + np.arange(int(sizes.sum()))]
        if len(sizes):
            body[out + sizes - 1] = 32
        bounds = np.append(out, len(body))[np.searchsorted(t, np.arange(n + 1))].tolist()
        view = memoryview(np.ascontiguousarray(body))
        digests = [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        left = part.column("text").to_pylist()
        for k in np.flatnonzero(removed).tolist():
            # A kept word brings the white space behind it.
            own = slice(int(first[k]), int(first[k] + words[k]))
            edges = np.append(starts[own], offsets[k + 1])
            left[k] = b"".join(data[a:b].tobytes() for a, b, w in zip(edges[:-1].tolist(), edges[1:].tolist(), keep[own].tolist(), strict=True) if w).decode().rstrip()
        columns = [c for k, c in enumerate(part.columns) if part.schema.names[k] not in ("text", "starts", "copy")]
        names = [c for c in part.schema.names if c not in ("text", "starts", "copy")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.string()), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(digests)], [*names, "text", "n_words", "n_removed", "kept_sha256"])


def repeated_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, starts, copy): where windows start that also start in a smaller ``doc_id``; of a copy all do."""
    spark = docs.sparkSession
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    digests = keyed.select("doc_id", "row_hash", text_digest().alias("digest"))
    classes = written(digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    copies = digests.join(classes.where("n > 1").select("digest", "first"), "digest").where("doc_id > first")
    members = spark.sparkContext.broadcast(member_bits(classes.select("first"), "first").tobytes())
    keyed = keyed.withColumn("hash", hash_of("doc_id"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = 1 << (int(min(MAX_CELLS, max(MIN_CELLS, size * CELLS_PER_BYTE))) - 1).bit_length()
    sketch = spark.sparkContext.broadcast(merged_sketch(keyed, cells, members).tobytes())
    passed = keyed.mapInArrow(passing(sketch, cells, members), "doc_id long, row_hash int, start int, low long, high long")
    firsts = passed.groupBy("low", "high").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("low", "high", "first")
    hits = passed.join(written(firsts), ["low", "high"]).where("doc_id > first").select("doc_id", "row_hash", "start", F.lit(False).alias("copy"))
    both = hits.union(copies.select("doc_id", "row_hash", F.lit(None).cast("int"), F.lit(True)))
    return both.groupBy("doc_id", "row_hash").agg(F.collect_set("start").alias("starts"), F.bool_or("copy").alias("copy"))


OWN = ["text", "n_words", "n_removed", "kept_sha256"]


def _cut(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``row``, with what is left of its text."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    joined = rows.join(repeated_starts(docs), ["doc_id", "row_hash"], "left").select("row", "text", "starts", "copy")
    own = StructType.fromDDL("text string, n_words long, n_removed long, kept_sha256 string")
    return joined.mapInArrow(removing, StructType([joined.schema["row"], *own.fields]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``, and n_words, n_removed, kept_sha256 (columns of these names are replaced)."""
    return _cut(docs).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in OWN], *OWN)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text`` and ``n_chars`` counted anew; no other column changes."""
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _cut(docs).select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def digest_repeats(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs.select("doc_id", "text")).drop("text")
