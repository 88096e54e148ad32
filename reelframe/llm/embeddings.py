"""Operator 1: near-duplicate vectors by Euclidean p-stable hashing, with exact cosine checks.

1. Equal vectors of one label are one class with a number of its own.
2. Each class's normalised vector is projected on Gaussian directions (2-stable); floor((a.x + b) / w)
   of ``HASHES`` directions is its bucket in one of ``TABLES`` tables.
3. Every pair of a bucket is checked by its cosine in double precision, in tiles of bounded size; a
   tile sends on only links that join parts.  Vectors travel as bytes, of four to a component where
   that loses nothing.
4. Components come from those links.  As all links of a vector lie in its component, each component is
   then compared exactly in tiles, which gives every vector its number of links; pairs never leave a
   task.

At a cosine of exactly 0.98 a table joins a pair with probability 0.92 ** 16, and all 40 tables miss it
once in 200,000; closer pairs are missed less.  Unrelated vectors share a table's bucket once in 100,000.

Vectors that are null, empty, zero or hold null or non-finite components, vectors without a label and
those without a ``vec_id`` link with nothing.  Vectors of other lengths don't link.  Rows that repeat a
vector count as vectors of their own; rows that share a ``vec_id`` are judged each by its vector.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelframe.llm.graph import blocked, bundles, candidate_rows, components, forest
from reelframe.llm.shared import salted_join, written
from reelframe.llm.words import U, mix

COSINE = 0.98
HASHES, TABLES, WIDTH, SEED = 16, 40, 2.0, 20240607
#: Vectors, and their components, in a block of a tile; and rows of small tiles that are compared together.
TILE, TILE_COMPONENTS, TOGETHER = 1024, 1 << 22, 256

_drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _drawn:
        draw = np.random.default_rng([SEED, size])
        _drawn[size] = draw.standard_normal((size, HASHES * TABLES)), draw.uniform(0, WIDTH, HASHES * TABLES)
    return _drawn[size]


def normalised(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def coding(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class with its vector as bytes and its bucket in every table."""
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            part = batch.filter(pa.array(sizes == size))
            project, shift = directions(size)
            step = max(1, min(1024, (1 << 22) // size))
            for k in range(0, part.num_rows, step):
                some = part.slice(k, step)
                rows = some.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                codes = np.floor((normalised(rows) @ project + shift) / WIDTH).astype(np.int64).view(U).reshape(-1, TABLES, HASHES)
                label = some.column("label").to_numpy().astype(np.int64).view(U)
                keys = mix(mix(label ^ U(size << 40))[:, None] + np.arange(1, TABLES + 1, dtype=U)[None, :])
                for h in range(HASHES):
                    keys = mix(keys ^ codes[:, :, h]) + U(h)
                with np.errstate(over="ignore"):
                    narrow = rows.astype("<f4")
                short = (narrow == rows).all(1)
                vectors = pa.array([(n if s else r).tobytes() for n, r, s in zip(narrow, rows, short.tolist(), strict=True)], pa.binary())
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), TABLES).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("id", "label", "size", "copies")), vectors, lists], ["id", "label", "size", "copies", "vector", "keys"])


def matrix(vectors: pa.ChunkedArray, size: int) -> np.ndarray:
    """Normalised rows in double precision from the bytes of vectors of one size."""
    rows = np.empty((len(vectors), size))
    for k, blob in enumerate(vectors):
        buffer = blob.as_buffer()
        rows[k] = np.frombuffer(buffer, "<f4" if buffer.size == 4 * size else "<f8")
    return normalised(rows)


def _cosines(table: pa.Table, tile: np.ndarray) -> np.ndarray:
    """Which rows link: of one tile, size and label, and of different blocks if the tile has two."""
    column = lambda c: table.column(c).to_numpy()
    sizes, labels, own, split = column("size"), column("label"), column("own"), column("i") != column("j")
    linked = np.zeros((len(sizes), len(sizes)), bool)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        rows = matrix(table.column("vector").take(pa.array(at)), size)
        linked[np.ix_(at, at)] = rows @ rows.T >= COSINE
    np.fill_diagonal(linked, False)
    linked &= (labels[:, None] == labels[None, :]) & (tile[:, None] == tile[None, :])
    return linked & (~split[:, None] | (own[:, None] != own[None, :]))


def joining(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, tile in bundles(batches, TOGETHER):
        ids = table.column("id").to_numpy()
        a, b = forest(_cosines(table, tile))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])


def counting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, tile in bundles(batches, TOGETHER):
        counts = _cosines(table, tile) @ table.column("copies").to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), pa.array(counts)], ["id", "links"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    # 128 bits tell vectors apart.
    digest = [F.when(fit, F.xxhash64(F.lit(seed), "label", "embedding")).alias(c) for seed, c in ((1, "low"), (2, "high"))]
    good = rows.where(fit).select("vec_id", "label", "embedding", *digest)
    classes = good.groupBy("low", "high").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # Numbers of classes are unique, and fixed once they are written.
    classes = written(classes.withColumns({"id": F.monotonically_increasing_id(), "size": F.size("embedding")}))
    coded = written(classes.mapInArrow(coding, "id long, label long, size int, copies long, vector binary, keys array<long>"))
    buckets = coded.select(F.explode("keys").alias("key"), "id", "size")
    vectors = coded.drop("keys")

    def grouped(df: DataFrame, *extra: str) -> DataFrame:
        spread = blocked(df.join(vectors, "id"), TILE, TILE_COMPONENTS).select("key", "i", "j", "own", "id", "label", "size", "vector", *extra)
        return spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    groups = written(components(grouped(candidate_rows(buckets, "size")).mapInArrow(joining, "a long, b long")))
    named = groups.join(classes.select("id", "first", "size"), "id")
    sizes = written(named.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("first").alias("component_id")))
    members = salted_join(groups, sizes, ["component"], "id").select(F.col("component").alias("key"), "n", "total", "id", "component_id")
    counts = grouped(members, "copies").mapInArrow(counting, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    found = classes.join(members.select("id", "component_id"), "id", "left").join(counts, "id", "left")
    found = found.select("low", "high", F.coalesce("component_id", "first").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    linked = salted_join(good.select("vec_id", "low", "high"), written(found), ["low", "high"], "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
