"""Words, word hashes and word windows of whole Arrow batches, in NumPy.

A batch of texts is one buffer of UTF-8 bytes with offsets.  Every function works on the whole
buffer at once; Python never loops over characters, words or windows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE_A, BASE_B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)

#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

CHUNK_BYTES = 1 << 21

_powers: dict[int, np.ndarray] = {}


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about ``limit`` bytes of text (one row at least), with bytes and offsets; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        text = pc.fill_null(text, "") if text.null_count else text
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(text):
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start), data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
            start = end


def find(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words, where ``inside`` marks the bytes of words."""
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = before.copy()
    cuts = offsets[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    follows = np.zeros(len(data) + 1, bool)
    follows[:-1] = inside
    follows[offsets] = False
    ends = np.flatnonzero(after & ~follows)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1024)
        have = np.full(size, base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 20:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``x`` over all 64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    body = data[inside].astype(U) + U(1)
    at = np.arange(len(body)) - np.repeat(first, lengths)
    body *= powers(BASE_A, int(lengths.max()))[at]
    return mix(np.add.reduceat(body, first) ^ (lengths.astype(U) << U(48)))


def windows(hashes: np.ndarray, text: np.ndarray, size: int, base: np.uint64 = BASE_B) -> tuple[np.ndarray, np.ndarray]:
    """Which words start a window of ``size`` words of one text, and a hash for each such window."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    if size <= 6:
        total = hashes[:n].copy()
        for k in range(1, size):
            total *= base
            total += hashes[k : k + n]
        return at, mix(total)[at]
    inverse = U(pow(int(base), -1, 1 << 64))
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    return at, mix((sums[size:] - sums[:-size]) * powers(inverse, n))[at]


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    span = 1
    while span * 2 <= size:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = size - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def per_text(flags_or_counts: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums by text number."""
    return np.bincount(text, weights=flags_or_counts, minlength=n).astype(np.int64)
