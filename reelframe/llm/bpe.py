"""Operator 11: byte-level BPE by a rank file, encoding and decoding.

A text is split by the pattern; each piece is resolved in two tiers.

1. A minimal perfect hash over the vocabulary (levels of bit arrays; the place of a token is the number of
   bits before its own) finds pieces that are tokens as they stand, for all pieces of a batch at once.
2. Other pieces are merged: their bytes are a linked list, and a heap gives the pair of lowest rank,
   leftmost first.  Distinct pieces are merged once per worker while ``MAX_MERGED`` have room.

Decoding gathers the bytes of each id.

Null text counts as empty, and has no ids; rows repeat as they come; an empty table gives no rows; other
columns are ignored.  Texts of any length are cut at white space after other text, where a piece always ends.
Ids that the vocabulary lacks raise an error in decoding; null ids decode to null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from reelframe.llm.tokens import KNOWN, pieces
from reelframe.llm.words import U, chunks, mix, word_hashes

#: Merged pieces kept per worker before the table starts anew.
MAX_MERGED = 1_000_000
#: Bytes of longer pieces are looked up as they are, not by a hash.
HASHED = 64
#: Characters of a text that are split at once.
SPAN = 1 << 20


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: n keys to 0 .. n - 1.

    Each level has two bits a key; keys alone at their bit stay there, the others go on to the next level.
    """

    def __init__(self, keys: np.ndarray) -> None:
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys are equal")
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        seen = 0
        while len(keys):
            size = 64 * max(1, -(-2 * len(keys) // 64))
            at = self.places(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, seen + np.cumsum(counts) - counts))
            seen += int(counts.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % U(size)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; what isn't a key gets any number, or -1."""
        found = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            at = self.places(keys[rest], level, size)
            word, bit = words[at >> 6], U(1) << (at & 63).astype(U)
            here = (word & bit) != 0
            found[rest[here]] = before[at[here] >> 6] + np.bitwise_count(word[here] & (bit[here] - U(1)))
            rest = rest[~here]
        return found


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of lowest rank is merged until there is none."""
    n = len(piece)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [r * n + i for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), n)
        j = ends[i]
        # The part at i may be merged into another (0), be the last, or have another neighbour by now.
        if not 0 < j < n or ranks.get(piece[i : ends[j]]) != rank:
            continue
        end = ends[i] = ends[j]
        ends[j] = 0
        if end < n:
            before[end] = i
            if (r := ranks.get(piece[i : ends[end]])) is not None:
                heappush(heap, r * n + i)
        p = before[i]
        if p >= 0 and (r := ranks.get(piece[p:end])) is not None:
            heappush(heap, r * n + p)
    found, i = [], 0
    while i < n:
        found.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return found


class Vocabulary:
    """The tokens of a rank file; made once per worker process by :func:`vocabulary`."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no token for byte {missing[0]}")
        tokens = sorted(self.ranks, key=self.ranks.get)
        size = self.ranks[tokens[-1]] + 1
        self.known, self.lengths = np.zeros(size, bool), np.zeros(size, np.int64)
        ids = np.array([self.ranks[t] for t in tokens])
        self.known[ids], self.lengths[ids] = True, np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        short = ids[self.lengths[ids] <= HASHED]
        hashes = word_hashes(self.data, np.ones(len(self.data), bool), self.begin[ids], self.begin[ids] + self.lengths[ids])[self.lengths[ids] <= HASHED]
        self.whole = PerfectHash(hashes)
        self.numbered, self.keys = np.zeros(len(short), np.int64), np.zeros(len(short), U)
        at = self.whole.look_up(hashes)
        self.numbered[at], self.keys[at] = short, hashes
        self.merged: dict[bytes, list[int]] = {}
        self.split = regex.compile(pattern)
        self.standard = pattern == public_tokenizers.PATTERN

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of all texts joined, in characters."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        plain = np.array([self.standard and (not t or ord(max(t)) < KNOWN) for t in texts], bool)
        own = np.repeat(plain, sizes)
        # Texts with other characters are split by the pattern itself; here they are one letter after another.
        starts = pieces(np.where(own, codes, 0x61), first[sizes > 0])
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        starts, ends = starts[own[starts]], ends[own[starts]]
        if plain.all():
            return starts, ends
        found = [np.array([m.span() for m in self.split.finditer(texts[k])], np.int64).reshape(-1, 2) + first[k] for k in np.flatnonzero(~plain)]
        more = np.concatenate(found)
        more = more[more[:, 1] > more[:, 0]]
        starts, ends = np.append(starts, more[:, 0]), np.append(ends, more[:, 1])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, ends = self.spans(texts)
        text = np.searchsorted(np.cumsum(sizes), starts, "right")
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        place = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), out=place[1:])
        raw = whole.encode()
        starts, ends = place[starts], place[ends]
        ids, counts = self.resolve(raw, starts, ends)
        per_text = np.bincount(text, weights=counts, minlength=len(texts)).astype(np.int64)
        return ids, per_text

    def resolve(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces (given by bytes) one after another, and how many each piece has."""
        data, lengths = np.frombuffer(raw, np.uint8), ends - starts
        inside = np.ones(len(data), bool)
        if int(lengths.sum()) < len(data):
            step = np.zeros(len(data) + 1, np.int8)
            step[starts] += 1
            step[ends] -= 1
            inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        hashes = word_hashes(data, inside, starts, ends)
        at = self.whole.look_up(hashes)
        rank = self.numbered[at]
        hit = (at >= 0) & (self.keys[at] == hashes) & (self.lengths[rank] == lengths) & (lengths <= HASHED)
        short = np.flatnonzero(~hit & (lengths <= HASHED))
        _, one, same = np.unique(hashes[short], return_index=True, return_inverse=True)
        long = np.flatnonzero(lengths > HASHED)
        distinct, which = np.append(short[one], long), np.append(short, long)
        same = np.append(same, len(one) + np.arange(len(long)))
        lists = [self.merge_once(raw[a:b]) for a, b in zip(starts[distinct].tolist(), ends[distinct].tolist(), strict=True)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat, first = np.fromiter((i for ids in lists for i in ids), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes
        counts = np.ones(len(starts), np.int64)
        counts[which] = sizes[same]
        begin = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        ids[begin[hit]] = rank[hit]
        n = counts[which]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ids[np.repeat(begin[which], n) + step] = flat[np.repeat(first[same], n) + step]
        return ids, counts

    def merge_once(self, piece: bytes) -> list[int]:
        found = self.merged.get(piece)
        if found is None:
            rank = self.ranks.get(piece)
            found = merge(piece, self.ranks) if rank is None else [rank]
            if len(piece) <= HASHED:
                if len(self.merged) >= MAX_MERGED:
                    self.merged.clear()
                self.merged[piece] = found
        return found

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and how many each id has."""
        ids = ids.astype(np.int64)
        wrong = (ids < 0) | (ids >= len(self.known))
        wrong[~wrong] = ~self.known[ids[~wrong]]
        if wrong.any():
            raise ValueError(f"the vocabulary has no id {ids[wrong][0]}")
        lengths = self.lengths[ids]
        total = np.cumsum(lengths)
        return self.data[np.repeat(self.begin[ids] - total + lengths, lengths) + np.arange(total[-1] if len(total) else 0)], lengths


_vocabularies: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def parts_of(text: str, span: int) -> list[str]:
    """A text in parts of about ``span`` characters, cut before a blank or line feed that follows other text."""
    parts, start = [], 0
    while len(text) - start > span:
        at = start + span
        while at < len(text) and (text[at] not in " \n" or text[at - 1].isspace()):
            at += 1
        parts.append(text[start:at])
        start = at
    return [*parts, text[start:]] if start < len(text) or not parts else parts


def encoded(batches: Iterable[pa.RecordBatch], ranks: str, pattern: str, span: int = SPAN) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows with their ids and how many each row has."""
    words = vocabulary(ranks, pattern)
    for part, _, _ in chunks(batches):
        texts = [t or "" for t in part.column("text").to_pylist()]
        if max(map(len, texts)) <= span or pattern != public_tokenizers.PATTERN:
            yield part, *words.encode(texts)
            continue
        ids, counts = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            for piece in parts_of(text, span):
                found, n = words.encode([piece])
                ids.append(found)
                counts[k] += n[0]
        yield part, np.concatenate(ids), counts


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_texts(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, counts in encoded(batches, ranks, pattern):
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, bytes) of rows with ``ids``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks)
        for batch in batches:
            values = [None if not ids.is_valid else words.decode(np.array(ids.as_py(), np.int64))[0].tobytes() for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary())], ["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per document the number of its ids, and digests of the ids and of what they decode to.

    Encoding and decoding happen in one pass, so neither ids nor bytes leave the task.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(ranks, pattern)
        for part, ids, counts in encoded(batches, ranks, pattern):
            data, lengths = words.decode(ids)
            ends = np.cumsum(counts)
            stops = np.concatenate([[0], np.cumsum(lengths)])
            raw, ids = data.tobytes(), ids.astype("<u4", copy=False).tobytes()
            a, b = ((ends - counts) * 4).tolist(), (ends * 4).tolist()
            of_ids = [hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(a, b, strict=True)]
            of_bytes = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(stops[ends - counts].tolist(), stops[ends].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
