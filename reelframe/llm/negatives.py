"""Operator 12: hard negatives by a vertical scan with shrinking candidate sets (BOND).

Rows are cut into blocks; in a block the vectors are columns of one dimension each.  Each anchor meets every
block once a pass, in tiles of a row block and an anchor block, both of bounded size, which are dealt by their
pair of numbers.  Within a tile an anchor reads the block's dimensions in order of its own components, largest
magnitude first, ``STEP`` at a time.  What the unread dimensions may still add lies between the sums of the
least and greatest products with the block's minima and maxima; a candidate whose range can't matter any more
leaves the bitmap.  What is left at the end has its exact score.

1. First pass: an anchor's candidates are the rows of its label; those leave whose upper bound is below the
   ``POSITIVES``-th greatest lower bound.  The best of all blocks are the anchor's positives.
2. Second pass: candidates are the rows of other labels; those leave whose range meets none of the windows
   that the positives' scores open.  Each block's best ``NEGATIVES`` of a window are merged.

Components are ``floor(256 * x)`` and scores are integers: sums of doubles while those are exact, else of integers of any
length.  A score that 64 bits can't hold matches nothing.

Rows without a label, a vector or a ``vec_id``, or with null or non-finite components, take no part.  Vectors of
another length than the anchor's don't match it.  Rows that share a ``vec_id`` are candidates each, but not for an anchor
of that ``vec_id``; anchors that share one are mined each.  Ties go to the smaller ``vec_id``.  An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.llm.shared import written

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Percents of the positive's score between which a negative is hard.
LOW, HIGH = 50, 95
#: Dimensions between two looks at the bounds.
STEP = 16
#: Components in a block of rows and of anchors, about, and those for which a block of rows is worth a task.
ROW_CELLS, ANCHOR_CELLS, LEAST_CELLS = 1 << 21, 1 << 19, 1 << 16
EXACT, LONGEST = 1 << 53, (1 << 63) - 1


def _floor(x: Column) -> Column:
    """Of a double as a double, whatever its size."""
    near = F.rint(x)
    return F.when(near > x, near - 1).otherwise(near)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, n): rows that take part, with whole components and their number."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL")
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < float("inf"))))
    return rows.select("vec_id", "label", F.transform("e", lambda x: _floor(x * SCALE)).alias("v"), F.size("e").alias("n"))


def matrix(rows: pa.Table, n: int) -> np.ndarray:
    """Vectors of ``n`` components as rows of an array."""
    values = rows.column("v").combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, n)


class Block:
    """Row vectors of one length by dimension, rows in order of their label."""

    def __init__(self, rows: pa.Table, n: int) -> None:
        rows = rows.sort_by([("label", "ascending")])
        self.ids, self.labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        self.columns = np.ascontiguousarray(matrix(rows, n).T)
        # Sums of products are exact while they stay below 2 ** 53.
        self.most = float(np.abs(self.columns).max(initial=0.0))
        self.ranges: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def range_of(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Minima and maxima of each dimension over rows a to b."""
        if (a, b) not in self.ranges:
            part = self.columns[:, a:b]
            self.ranges[a, b] = (part.min(1), part.max(1))
        return self.ranges[a, b]

    def scan(self, q: np.ndarray, a: int, b: int, start: np.ndarray, useful) -> tuple[np.ndarray, list[int] | np.ndarray]:
        """Rows of a to b marked in ``start`` that stay useful, and their scores.

        ``useful(low, high)`` tells which candidates may still matter when their scores lie in these bounds.
        """
        low, high = self.range_of(a, b)
        left = np.flatnonzero(start)
        if np.abs(q).sum() * self.most >= EXACT / 2:
            return a + left, self.long_scores(q, a + left)
        order = np.argsort(-np.abs(q), kind="stable")
        least, most = np.minimum(q * low, q * high)[order], np.maximum(q * low, q * high)[order]
        rest_low, rest_high = np.append(np.cumsum(least[::-1])[::-1], 0.0), np.append(np.cumsum(most[::-1])[::-1], 0.0)
        scores = np.zeros(len(left))
        for k in range(0, len(q), STEP):
            dims = order[k : k + STEP]
            part = self.columns[dims, a:b] if len(left) == b - a else self.columns[dims[:, None], (a + left)[None, :]]
            scores += q[dims] @ part
            k = min(k + STEP, len(q))
            keep = useful(scores + rest_low[k], scores + rest_high[k])
            if not keep.all():
                left, scores = left[keep], scores[keep]
            if not len(left):
                break
        return a + left, scores

    def long_scores(self, q: np.ndarray, rows: np.ndarray) -> list[int]:
        own = [int(x) for x in q]
        return [sum(x * int(y) for x, y in zip(own, self.columns[:, r], strict=True)) for r in rows.tolist()]


def best(ids: np.ndarray, scores, most: int) -> list[tuple[int, int]]:
    """The ``most`` greatest (score, id), ties by the smaller id."""
    if isinstance(scores, list):
        return sorted(((s, i) for s, i in zip(scores, ids.tolist(), strict=True) if -LONGEST <= s <= LONGEST), key=lambda x: (-x[0], x[1]))[:most]
    if len(scores) > most:
        at = np.flatnonzero(scores >= np.partition(scores, -most)[-most])
        ids, scores = ids[at], scores[at]
    order = np.lexsort((ids, -scores))[:most]
    return [(int(scores[k]), int(ids[k])) for k in order]


def above(most: int):
    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, -most)[-most] if len(low) > most else np.ones(len(low), bool)

    return useful


def window_of(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and greatest score s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def within(windows: list[tuple[int, int]], most: int):
    def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for first, last in windows:
            sure = low[(low >= first) & (high <= last)]
            floor = max(first, np.partition(sure, -most)[-most]) if len(sure) >= most else first
            keep |= (high >= floor) & (low <= last)
        return keep

    return useful


def tiles(first: bool, positives: int, negatives: int):
    """The work of one pass on a block of rows and a block of anchors."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        for n in set(anchors.column("n").to_pylist()) if rows.num_rows else ():
            own, some = rows.filter(pc.equal(rows.column("n"), n)), anchors.filter(pc.equal(anchors.column("n"), n))
            if not own.num_rows:
                continue
            block, queries = Block(own, n), matrix(some, n)
            listed = [[]] * some.num_rows if first else some.column("positives").to_pylist()
            for q, number, vec_id, label, opened in zip(queries, some.column("anchor").to_pylist(), some.column("vec_id").to_pylist(), some.column("label").to_pylist(), listed, strict=True):
                a, b = np.searchsorted(block.labels, [label, label + 1]).tolist()
                if first:
                    if a == b:
                        continue
                    at, scores = block.scan(q, a, b, block.ids[a:b] != vec_id, above(positives))
                    found += [(number, 0, score, i) for score, i in best(block.ids[at], scores, positives)]
                    continue
                windows = [window_of(p["score"]) for p in opened]
                if all(x > y for x, y in windows) or b - a == len(block.labels):
                    continue
                other = block.ids != vec_id
                other[a:b] = False
                at, scores = block.scan(q, 0, len(other), other, within([w for w in windows if w[0] <= w[1]], negatives))
                ids = block.ids[at]
                for p, (x, y) in zip(opened, windows, strict=True):
                    if isinstance(scores, list):
                        inside = [k for k, s in enumerate(scores) if x <= s <= y]
                        hits = best(ids[inside], [scores[k] for k in inside], negatives)
                    else:
                        inside = (scores >= x) & (scores <= y)
                        hits = best(ids[inside], scores[inside], negatives)
                    found += [(number, p["place"], score, i) for score, i in hits]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["anchor", "place", "score", "vec_id"])

    return run


def grid(cells: int, anchor_cells: int, tasks: int, every: int) -> tuple[int, int]:
    """Blocks of rows and of anchors: small enough for a task, at least ``tasks`` tiles where there is work for them.

    As anchors are few, rows are cut finer, which copies least.
    """
    rows = max(-(-cells // ROW_CELLS), min(-(-cells // LEAST_CELLS), round((every * tasks) ** 0.5)), 1)
    return rows, max(-(-anchor_cells // ANCHOR_CELLS), -(-tasks // rows) if cells > LEAST_CELLS * rows else 1, 1)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row whose ``vec_id`` ``every`` divides."""
    spark = vectors.sparkSession
    rows = written(usable(vectors))
    anchors = written(rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id()))
    cells, anchor_cells = (t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n for t in (rows, anchors))
    n_rows, n_anchors = grid(cells, anchor_cells, int(spark.conf.get("spark.sql.shuffle.partitions")), every)
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    row_tiles = numbered.select("vec_id", "label", "v", "n", part(n_rows).alias("r"), everywhere(n_anchors).alias("a"))

    def scanned(some: DataFrame, first: bool) -> DataFrame:
        anchor_tiles = some.withColumn("_row", F.col("anchor")).select(*some.columns, part(n_anchors).alias("a"), everywhere(n_rows).alias("r"))
        pairs = row_tiles.groupBy("r", "a").cogroup(anchor_tiles.groupBy("r", "a"))
        found = pairs.applyInArrow(tiles(first, positives, negatives), "anchor long, place int, score long, vec_id long")
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order))

    near = scanned(anchors, True).where(F.col("rank") <= positives)
    opened = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("place"), "score", "vec_id"))).alias("positives"))
    asked = written(anchors.join(opened, "anchor"))
    far = scanned(asked, False).where(F.col("rank") <= negatives)
    named = asked.select("anchor", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor", "anchor_id", F.col("p.place").alias("place"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return named.join(far, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
