"""Connected components of a table of links, and blocks of groups of any size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reelframe.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of a link (a, b); the component is its smallest id.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes.  A hub's links meet
    in no single task: minima are pre-aggregated, and the joins are plain joins of two tables, which
    adaptive execution splits by size.
    """
    edges = written(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    seen = None
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = written(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(least)
        edges = written(small.distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(edges.select("lo", "lo").distinct())


def candidate_rows(bands: DataFrame, weight: str) -> DataFrame:
    """(key, n, total, id) of the buckets that hold several ids, from (key, id, weight) rows.

    ``total`` sums the members' weights.  Most buckets hold one id and go first, by a count alone.  Buckets
    with the same ids are one: two hashes over the ids and their number tell them apart, all pre-aggregated,
    so that no bucket is ever gathered.
    """
    several = written(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    rows = written(bands.join(several, "key").select("key", "id", weight))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(weight).alias("total"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    groups = written(groups.groupBy("n", "total", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "total"))
    return rows.join(groups, "key").select("key", "n", "total", "id")


def blocked(rows: DataFrame, size: int, limit: int) -> DataFrame:
    """Adds i, j and own: a group of over ``size`` rows, or ``limit`` weight, becomes tiles of block i against block j.

    Every pair of a group's rows meets in exactly one tile, and a tile holds about ``2 * size`` rows and
    twice ``limit`` at most, however large the group is (a row of more than ``limit`` alone excepted).
    """
    blocks = F.greatest(F.ceil(F.col("n") / size), F.least(F.ceil(F.col("total") / limit), F.col("n"))).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def bundles(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole tiles of sorted rows, small ones together up to ``most`` rows, with each row's tile number."""
    held: list[pa.RecordBatch] = []
    flags: list[np.ndarray] = []
    last = None

    def parts(table: pa.Table, new: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        starts, begin = np.append(np.flatnonzero(new), len(new)), 0
        while begin < len(new):
            end = int(starts[max(np.searchsorted(starts, begin, "right"), np.searchsorted(starts, begin + most, "right") - 1)])
            yield table.slice(begin, end - begin), np.cumsum(new[begin:end]) - 1
            begin = end

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")])
        new = np.ones(batch.num_rows, bool)
        new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
        new[0] = last is None or bool((keys[:, 0] != last).any())
        last = keys[:, -1]
        held.append(batch)
        flags.append(new)
        if new.any():
            table, new = pa.Table.from_batches(held), np.concatenate(flags)
            cut = int(np.flatnonzero(new)[-1])
            yield from parts(table.slice(0, cut), new[:cut])
            held, flags = table.slice(cut).to_batches(), [new[cut:]]
    if held:
        yield from parts(pa.Table.from_batches(held), np.concatenate(flags))


def tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of equal (key, i, j) in sorted rows, also across batches."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[:, a].tolist())
            if kept and now != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = now
    if kept:
        yield pa.Table.from_batches(kept)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the symmetric matrix ``linked`` joins: each row with the first row of its part."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    rest = np.flatnonzero(label != np.arange(n))
    return rest, label[rest]
