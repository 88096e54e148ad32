"""Operator 10: near copies by BagMinHash over multisets of five-word shingles.

1. Equal texts are one class with a number of its own; only its document of smallest ``doc_id`` goes on.
2. Each class gets a BagMinHash signature: every shingle has, for each dyadic range of its weight, a
   Poisson process whose points fall on random registers; a point counts if the shingle's weight
   reaches it, and a register keeps the earliest.  Registers of two multisets are equal with the
   probability of their weighted Jaccard similarity.  Points later than a text's latest register are
   never made.
3. Signatures are cut into bands; classes that share a band are candidates.
4. Every pair within a bucket is verified by the exact overlap of the two multisets, in tiles of
   bounded size, and only links that join parts leave the task.
5. Connected components of the links are the groups; the document of smallest ``doc_id`` stays.

Fixed results: texts of one to four words have one shingle, of all their words; texts without a word,
and null texts, have none: the former link with equal texts only, the latter with nothing.  Rows
without ``doc_id`` link with nothing and stay.  Rows that share a ``doc_id`` are judged each by its text; if
two of a group share the smallest, the one of smaller digest stays.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reelframe.llm.graph import blocked, candidate_rows, components, forest, tiles
from reelframe.llm.members import hash_of, member_bits, pass_members
from reelframe.llm.shared import salted_join, text_digest, written
from reelframe.llm.words import NOT_SPACE, U, chunks, find, mix, windows, word_hashes

SHINGLE = 5
#: A similarity of NUMERATOR / DENOMINATOR links.
NUMERATOR, DENOMINATOR = 4, 5
#: At a similarity of exactly 0.8, 24 bands of 4 registers miss three pairs in a million.
BANDS, ROWS = 24, 4
#: Classes, and their shingles, in a block of a verified tile.
TILE, TILE_SHINGLES = 512, 1 << 22


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text number, hash, how often), ordered by text and hash."""
    inside = NOT_SPACE[data]
    starts, ends, text = find(data, offsets, inside)
    hashes = word_hashes(data, inside, starts, ends)
    at, grams = windows(hashes, text, SHINGLE)
    owner = text[at]
    words = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        first = np.cumsum(words) - words
        whole = np.zeros(len(short), U)
        for k in range(SHINGLE - 1):
            has = words[short] > k
            whole[has] = mix(whole[has] ^ hashes[first[short[has]] + k])
        grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], grams[at], np.diff(np.append(at, len(grams)))


def bag_minhash(owner: np.ndarray, grams: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """Signatures (n, registers) of n multisets; infinite where a multiset is empty."""
    signature = np.full(n * registers, np.inf)
    item, low, span = [np.arange(len(grams))], [np.zeros(len(grams))], [np.ones(len(grams))]
    reach = 1
    while len(more := np.flatnonzero(weight > reach)):
        item.append(more)
        low.append(np.full(len(more), float(reach)))
        span.append(np.full(len(more), float(reach)))
        reach *= 2
    item, low, span = (np.concatenate(x) for x in (item, low, span))
    key, doc, top = mix(grams[item] ^ mix(low.astype(U) + U(1))), owner[item], weight[item]
    time, turn = np.zeros(len(item)), 0
    while len(key):
        turn += 1
        first = mix(key + U(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((first >> U(11)) + U(1)).astype(np.float64) * 2.0**-53) / span
        second = mix(first ^ U(0xD6E8FEB86659FD93))
        counts = low + span * ((second & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < top
        place = doc * registers + ((second >> U(32)) * U(registers) >> U(32)).astype(np.int64)
        np.minimum.at(signature, place[counts], time[counts])
        go = time < signature.reshape(n, registers).max(1)[doc]
        key, doc, top, time, low, span = (x[go] for x in (key, doc, top, time, low, span))
    return signature.reshape(n, registers)


def signing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in chunks(batches):
        n = part.num_rows
        owner, grams, weight = shingles(data, offsets)
        values = bag_minhash(owner, grams, weight, n, BANDS * ROWS)
        some = np.flatnonzero(np.isfinite(values[:, 0]))
        codes = values[some].view(U).reshape(-1, BANDS, ROWS)
        keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), codes.shape[:2]).copy()
        for k in range(ROWS):
            keys = mix(keys ^ codes[:, :, k]) + U(k)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
        sizes = np.bincount(owner, weights=weight, minlength=n).astype(np.int64)[some]
        at = pa.array(some)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("digest").take(at), pa.array(sizes), lists], ["doc_id", "digest", "size", "keys"])


def listing(members):
    """The multiset of each text as sorted hashes, the k-th copy of a shingle with a hash of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(members.value, U)
        yield from _listing(pass_members(b, "hash", words) for b in batches)

    return run


def _listing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in chunks(batches):
        owner, grams, weight = shingles(data, offsets)
        copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
        grams, owner = mix(np.repeat(grams, weight) + copy.astype(U) * U(0xA24BAED4963EE407)), np.repeat(owner, weight)
        grams = grams[np.lexsort((grams, owner))]
        bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).tolist()
        blobs = [grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), pa.array(blobs, pa.binary())], ["doc_id", "digest", "grams"])


def overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each tile, thinned to a forest."""
    for tile in tiles(batches):
        ids = tile.column("id").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), U) for x in tile.column("grams")]
        own = tile.column("own").to_numpy()
        across = tile.column("i")[0].as_py() != tile.column("j")[0].as_py()
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        _, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        linked = np.zeros((len(ids), len(ids)), bool)
        marks = np.zeros(int(numbers.max()) + 1, bool)
        for k in range(len(ids) - 1):
            mine = numbers[begins[k] : begins[k] + sizes[k]]
            marks[mine] = True
            tail = begins[k + 1]
            common = np.add.reduceat(marks[numbers[tail:]], begins[k + 1 :] - tail, dtype=np.int64)
            marks[mine] = False
            linked[k, k + 1 :] = DENOMINATOR * common >= NUMERATOR * (sizes[k] + sizes[k + 1 :] - common)
        if across:
            linked &= own[:, None] != own[None, :]
        a, b = forest(linked | linked.T)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def near_groups(docs: DataFrame) -> DataFrame:
    """(digest, component_id, stays) per distinct text: its group's smallest ``doc_id``, and the digest of the text that stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    keyed = docs.withColumn("digest", text_digest())
    classes = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    # Numbers of classes are unique, and fixed once they are written.
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    signed = keyed.mapInArrow(signing, "doc_id long, digest string, size long, keys array<long>").join(classes, ["doc_id", "digest"])
    signed = written(signed.select("id", "size", "keys").dropDuplicates(["id", "size", "keys"]))
    rows = candidate_rows(signed.select(F.explode("keys").alias("key"), "id", "size"), "size")
    rows = written(rows.join(classes, "id"))
    members = docs.sparkSession.sparkContext.broadcast(member_bits(rows.select("doc_id").distinct(), "doc_id").tobytes())
    texts = keyed.select("doc_id", "digest", hash_of("doc_id").alias("hash"), "text")
    sets = texts.mapInArrow(listing(members), "doc_id long, digest string, grams binary").groupBy("doc_id", "digest").agg(F.first("grams").alias("grams"))
    placed = blocked(rows.join(sets, ["doc_id", "digest"]), TILE, TILE_SHINGLES)
    links = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "own", "id", "grams").mapInArrow(overlaps, "a long, b long")
    groups = classes.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = written(groups.select("digest", "doc_id", "component"))
    names = groups.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("least"))
    return salted_join(groups, names, ["component"], "digest").select("digest", F.col("least.doc_id").alias("component_id"), F.col("least.digest").alias("stays"))


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, component_id, kept) for every row of ``docs``."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))
    named = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    found = salted_join(keyed.where(named), written(near_groups(docs)), ["digest"], "doc_id")
    found = found.select("doc_id", "digest", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("digest") == F.col("stays"))).alias("kept"))
    lone = keyed.where(~named).select("doc_id", "digest", (F.col("doc_id") + 0).alias("component_id"), F.lit(True).alias("kept"))
    return found.union(lone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; of rows that repeat its ``doc_id`` and text one stays."""
    stay = near_copies(docs).where("kept AND doc_id IS NOT NULL").distinct().select("doc_id", F.coalesce("digest", F.lit("")).alias("digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text_digest(), F.lit("")).alias("digest"))
    first = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("digest"))
    named = rows.where("doc_id IS NOT NULL").join(stay, ["doc_id", "digest"]).withColumn("rank", first).where("rank = 1").select("row")
    return named.union(rows.where("doc_id IS NULL").select("row")).select("row.*")
