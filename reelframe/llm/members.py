"""A membership filter of bounded size: tells tasks which rows to leave out before a shuffle.

It lets a few other rows pass, so an exact join must follow; it never leaves out a member.  Beyond
``MAX_BITS`` it only passes more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 26


def hash_of(column: str) -> Column:
    return F.xxhash64(F.col(column).cast("long"))


def member_bits(rows: DataFrame, column: str) -> np.ndarray:
    """Words of 64 bits, merged by Spark; MAX_BITS / 8 bytes at most."""
    n = rows.count()
    bits = 1 << (min(MAX_BITS, max(MIN_BITS, 16 * n)) - 1).bit_length()
    h = hash_of(column)
    places = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 27), F.lit(bits)))).alias("place")
    words = rows.select(places).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()
    found = np.zeros(bits // 64, np.int64)
    found[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return found.view(np.uint64)


def pass_members(batch: pa.RecordBatch, column: str, words: np.ndarray) -> pa.RecordBatch:
    """The rows of ``batch`` whose hash (see :func:`hash_of`) may belong to a member."""
    h = batch.column(column).to_numpy(zero_copy_only=False)
    bits = len(words) * 64
    keep = np.ones(len(h), bool)
    for place in (h % bits, (h >> 27) % bits):
        keep &= (words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return batch.filter(pa.array(keep))
