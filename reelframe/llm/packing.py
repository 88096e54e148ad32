"""Operator 4: packing token pieces into windows by minimum bin slack.

Each task packs the documents of its own partition in blocks of bounded size, so nothing is shuffled
and memory doesn't grow with the table.  A document's full windows stand alone.  The rests of a block
are a multiset of lengths; for each window, seeded with the longest rest, a bitset subset-sum finds
the rests that come closest to its capacity, and the counts traced back are used as often as they
last.  The block's one window that stays less than half full is cut into lengths that are powers of
two, which need no padding.

Null text counts as empty, repeated rows are packed each for itself, an empty table gives no rows,
and other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reelframe.llm.tokens import encoder
from reelframe.llm.words import chunks

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Rests that are packed together, and bytes of text that are encoded at once.
BLOCK, CHUNK = 4096, 1 << 19


def fill(counts: list[int], capacity: int) -> list[int]:
    """The multiset of lengths whose sum comes closest to ``capacity``; ``counts[l]`` are at hand of length l."""
    reach, mask, trail = 1, (1 << (capacity + 1)) - 1, []
    full = 1 << capacity
    for length in range(capacity, 0, -1):
        for _ in range(min(counts[length], capacity // length)):
            more = (reach << length) & mask & ~reach
            if not more:
                break
            trail.append((length, reach))
            reach |= more
            if reach & full:
                break
        if reach & full:
            break
    total, used = reach.bit_length() - 1, []
    for length, before in reversed(trail):
        if not before >> total & 1:
            used.append(length)
            total -= length
    return used


def plan(lengths: list[int], window: int) -> list[tuple[list[int], int]]:
    """Windows as (lengths, times used) for the multiset ``lengths``."""
    counts = [0] * (window + 1)
    for length in lengths:
        counts[length] += 1
    found = []
    for seed in range(window, 0, -1):
        while counts[seed]:
            counts[seed] -= 1
            one = [seed, *fill(counts, window - seed)]
            counts[seed] += 1
            need = {length: one.count(length) for length in one}
            times = min(counts[length] // n for length, n in need.items())
            for length, n in need.items():
                counts[length] -= n * times
            found.append((one, times))
    return found


def packer(tokenizer: str, window: int, end_id: int, block: int):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        next_sequence = TaskContext.get().partitionId() << 36
        rests: list[tuple] = []  # doc_id, start, ids, doc_tokens
        out: list[tuple] = []

        def put(doc, start, ids, tokens, sequence, offset):
            out.append((doc, start, len(ids), zlib.crc32(ids), tokens, sequence, offset))

        def flush():
            nonlocal next_sequence
            by_length: dict[int, list[tuple]] = {}
            for r in rests:
                by_length.setdefault(len(r[2]), []).append(r)
            for lengths, times in plan([len(r[2]) for r in rests], window):
                for _ in range(times):
                    part = [by_length[n].pop() for n in lengths]
                    used, room, offset = sum(lengths), window, 0
                    if used <= window // 2:
                        room = 1 << (used.bit_length() - 1)
                    for doc, start, ids, tokens in part:
                        while len(ids):
                            piece = ids[: room - offset]
                            put(doc, start, piece, tokens, next_sequence, offset)
                            start, ids, offset, used = start + len(piece), ids[len(piece) :], offset + len(piece), used - len(piece)
                            if offset == room and used:
                                next_sequence, room, offset = next_sequence + 1, 1 << (used.bit_length() - 1), 0
                    next_sequence += 1
            rests.clear()

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return made

        # What the worker's task before held goes back first.
        pa.default_memory_pool().release_unused()
        for part, _, _ in chunks(batches, limit=CHUNK):
            ids, counts = encode([t or "" for t in part.column("text").to_pylist()])
            begin = 0
            for doc, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                own = np.append(ids[begin : begin + n], np.uint32(end_id)).astype("<u4")
                begin += n
                full = len(own) // window * window
                for start in range(0, full, window):
                    put(doc, start, own[start : start + window], n + 1, next_sequence, 0)
                    next_sequence += 1
                if full < len(own):
                    # A copy, for a view would keep the whole document's ids.
                    rests.append((doc, full, own[full:].copy(), n + 1))
            if len(rests) >= block:
                flush()
            if len(out) >= 10_000:
                yield emit()
        flush()
        if out:
            yield emit()

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, block: int = BLOCK) -> DataFrame:
    """Pieces of all documents with their places; see the module's text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(packer(tokenizer, window, end_id, block), SCHEMA)
