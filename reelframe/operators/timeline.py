"""Time-line operators: segments, as-of look-up, interval closing, downsampling (TL1-TL5, WN3-WN4, JN12-JN13, AG8-AG9, AG12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.operators.running import LAST, SUM, running
from reelframe.sources.workspace import stored

SECOND = 1_000_000_000
SEGMENT, TAIL, TOLERANCE = 4 * SECOND, 1 * SECOND, 2_000_000
MOST_BUCKETS = 200
GAP = 4


def ordered_keyframes(keyframes: DataFrame) -> DataFrame:
    """TL3: one sorted, duplicate-free series per file (a file's key frames are bounded by its length)."""
    return keyframes.groupBy("file_id").agg(F.array_sort(F.collect_set("t_ns")).alias("series"), F.max("duration_ns").alias("duration_ns"))


def greedy(series: Column, duration: Column) -> Column:
    """TL1: start at 0; take t if it is 4 s past the last start and 1 s before the end."""
    step = lambda acc, t: F.when((t >= F.element_at(acc, -1) + SEGMENT) & (t + TAIL < duration), F.concat(acc, F.array(t))).otherwise(acc)
    return F.aggregate(series, F.array(F.lit(0).cast("bigint")), step)


def uniform(duration: Column) -> Column:
    """TL2: a start every 4 s that is 1 s before the end."""
    return F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(duration - 1, F.lit(0)), F.lit(SEGMENT)), lambda t: (t == 0) | (t + TAIL < duration))


def segments(files: DataFrame) -> DataFrame:
    """Starts of each file: greedy over its key frames, uniform where it has none."""
    starts = F.when(F.size("series") > 0, greedy(F.col("series"), F.col("duration_ns"))).otherwise(uniform(F.col("duration_ns")))
    return files.select("file_id", "duration_ns", F.posexplode(starts).alias("idx", "start_ns"))


def chained_segments(keyframes: DataFrame) -> DataFrame:
    """TL1 for series of any length: (file_id, duration_ns, idx, start_ns) without a task that sees all of a file.

    Each key frame points to the first one ``SEGMENT`` on, found over ranges; the starts are those on the chain from 0.
    The chain is followed by doubling: round k adds to what is reached all that lies 2 ** k pointers on, so
    a file of n segments takes log2(n) rounds.
    """
    files = keyframes.groupBy("file_id").agg(F.max("duration_ns").cast("bigint").alias("duration_ns"))
    # A frame that is too near the end is never a start, nor is any after it.
    usable = keyframes.join(files.withColumnRenamed("duration_ns", "_end"), "file_id").where(F.col("t_ns") + TAIL < F.col("_end")).select("file_id", "t_ns").distinct()
    origin = files.select("file_id", F.lit(0).cast("bigint").alias("t_ns"))
    nodes = usable.where("t_ns > 0").unionByName(origin)
    asked = nodes.select("file_id", (F.col("t_ns") + SEGMENT).alias("at"), F.lit(0).alias("kind"), F.col("t_ns").alias("node"), F.lit(None).cast("bigint").alias("frame"))
    given = usable.select("file_id", F.col("t_ns").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("node"), F.col("t_ns").alias("frame"))
    following = running(asked.unionByName(given), ["file_id"], ["at", "kind"], {"to": "frame"}, LAST, reverse=True)
    jumps = following.where("kind = 0 AND to IS NOT NULL").select("file_id", F.col("node").alias("at"), "to")
    reached, span = origin.withColumn("idx", F.lit(0)), 1
    while True:
        jumps = stored(jumps, "jumps")
        new = reached.withColumnRenamed("t_ns", "at").join(jumps, ["file_id", "at"]).select("file_id", F.col("to").alias("t_ns"), (F.col("idx") + span).alias("idx"))
        new = stored(new, "reached")
        if new.isEmpty():
            return reached.join(files, "file_id").select("file_id", "duration_ns", F.col("idx").cast("int").alias("idx"), F.col("t_ns").alias("start_ns"))
        reached = stored(reached.unionByName(new), "reached")
        onward = jumps.select("file_id", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps, span = jumps.join(onward, ["file_id", "to"]).select("file_id", "at", F.col("beyond").alias("to")), span * 2


def durations(starts: DataFrame) -> DataFrame:
    """WN3: to the next start, the last to the end; never below 0."""
    following = F.lead("start_ns").over(Window.partitionBy("file_id").orderBy("idx"))
    return starts.withColumn("length_ns", F.greatest(F.coalesce(following, "duration_ns") - F.col("start_ns"), F.lit(0)))


def summary(timed: DataFrame) -> DataFrame:
    """AG9: how many segments, and the target in whole seconds."""
    return timed.groupBy("file_id").agg(F.count("*").alias("n"), F.ceil(F.max("length_ns") / SECOND).cast("bigint").alias("target_s"))


def segment_of(starts: DataFrame, points: DataFrame) -> DataFrame:
    """JN13: the last segment that starts at or before t + 2 ms, carried over ranges, so a file may have any number of points."""
    both = starts.select("file_id", F.col("start_ns").alias("at"), F.lit(0).alias("kind"), "idx", F.lit(None).cast("bigint").alias("t_ns"), F.lit(0).cast("bigint").alias("n"))
    # Equal points are one row with their number.
    some = points.groupBy("file_id", "t_ns").agg(F.count("*").alias("n"))
    both = both.unionByName(some.select("file_id", (F.col("t_ns") + TOLERANCE).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("idx"), "t_ns", "n"))
    found = running(both, ["file_id"], ["at", "kind"], {"segment": "idx"}, LAST).where("kind = 1")
    found = found.select("file_id", "t_ns", F.coalesce("segment", F.lit(0)).alias("segment"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    return found.drop("col")


def closed_chapters(chapters: DataFrame) -> DataFrame:
    """WN4: an end that isn't past the start becomes the next start, else the duration, else the start."""
    following = F.lead("start_s").over(Window.partitionBy("file_id").orderBy("start_s", "title"))
    end = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(F.coalesce(following, "duration_s", "start_s"))
    return chapters.select("file_id", "start_s", end.alias("end_s"), "title", "duration_s")


def chapter_at(chapters: DataFrame, points: DataFrame) -> DataFrame:
    """JN12, WN10: the chapter that holds t, else the last once it has begun, and how far t is into it.

    Only files of several chapters and of known duration show any; a moment between chapters has none (null).
    """
    whole, order = F.struct("title", "start_s", "end_s"), F.struct("start_s", "title")
    many = chapters.groupBy("file_id").agg(F.count("*").alias("n"), F.max("duration_s").alias("duration"), F.max_by(whole, order).alias("last")).where("n > 1 AND duration > 0")
    held = (F.col("t") >= F.col("start_s")) & (F.col("t") < F.col("end_s"))
    inside = points.join(chapters, "file_id").where(held).groupBy("file_id", "t").agg(F.min_by(whole, order).alias("inside"))
    found = points.join(many, "file_id").join(inside, ["file_id", "t"], "left").select("file_id", "t", F.coalesce("inside", F.when(F.col("t") >= F.col("last.start_s"), F.col("last"))).alias("c"))
    span = F.col("c.end_s") - F.col("c.start_s")
    part = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("c.start_s")) / F.nullif(span, F.lit(0))))).when(span.isNotNull(), 0.0)
    return found.select("file_id", "t", F.col("c.title").alias("title"), F.round(part, 6).alias("fraction"))


def piece_buckets(pieces: DataFrame) -> DataFrame:
    """AG8: share of present pieces, 0 to 255, in at most 200 buckets per file.

    The number of pieces is a window over the file: ``pieces`` are read once and aren't joined with themselves, and a file's rows
    beyond a few thousand wait on disk.
    """
    sized = pieces.withColumn("n", F.max("piece").over(Window.partitionBy("file_id")) + 1)
    b = F.least(F.lit(MOST_BUCKETS), F.col("n"))
    bucket = F.floor(((F.col("piece") + 1) * b - 1) / F.col("n"))
    held = F.sum(F.col("have").cast("bigint"))
    return sized.where("file_id IS NOT NULL").groupBy("file_id", bucket.alias("bucket")).agg(F.floor(held * 255 / F.count("*")).alias("level"))


def without_pieces(files: DataFrame) -> DataFrame:
    """AG8 for files without pieces: 200 zeros."""
    return files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(MOST_BUCKETS - 1)).cast("array<bigint>")).alias("bucket"), F.lit(0).cast("bigint").alias("level"))


def expand_runs(runs: DataFrame, shifts: DataFrame) -> DataFrame:
    """TL4: (run, count, delta) tables to times: prefix sums of the deltas, shifted per sample, never below 0.

    Sums run over runs, not samples: each run's base is a window over the short table, and samples inside
    a run are arithmetic.
    """
    base = Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumns({"base": F.coalesce(F.sum(F.col("n") * F.col("delta")).over(base), F.lit(0)), "first": F.coalesce(F.sum("n").over(base), F.lit(0))})
    samples = placed.select("file_id", "run", "delta", "base", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    at = samples.select("file_id", (F.col("first") + F.col("k")).alias("sample"), (F.col("base") + F.col("k") * F.col("delta")).alias("decode"))
    shifted = at.join(shifts, ["file_id", "sample"], "left")
    return shifted.select("file_id", "sample", F.greatest(F.col("decode") + F.coalesce("shift", F.lit(0)), F.lit(0)).alias("t"))


def presentation_times(decode: DataFrame, composition: DataFrame, tracks: DataFrame) -> DataFrame:
    """TL4: the time in ns of every sample: (file_id, sample, t).

    ``decode`` has runs (run, n, delta) of steps, ``composition`` runs (run, n, offset) of what is added to a sample's
    time; samples beyond its runs get nothing.  ``tracks`` has the first ``media_time`` that isn't negative of the edit list, or
    null, and the ``timescale`` in ticks a second.  Times are never below 0 and are cut to whole ns.
    """
    before = Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")
    added = composition.where("n > 0").withColumn("first", first).select("file_id", "first", "offset", every)
    added = added.select("file_id", (F.col("first") + F.col("k")).alias("sample"), "offset")
    base = decode.where("n > 0").withColumns({"base": F.coalesce(F.sum(F.col("n") * F.col("delta")).over(before), F.lit(0)), "first": first})
    samples = base.select("file_id", "base", "first", "delta", every).select("file_id", (F.col("first") + F.col("k")).alias("sample"), (F.col("base") + F.col("k") * F.col("delta")).alias("ticks"))
    placed = samples.join(added, ["file_id", "sample"], "left").join(tracks, "file_id")
    ticks = F.greatest(F.col("ticks") + F.coalesce("offset", F.lit(0)) - F.coalesce("media_time", F.lit(0)), F.lit(0))
    # Ticks times 10 ** 9 may be too large for a long.
    scaled = F.expr("cast(_ticks AS decimal(20, 0)) * 1000000000 div cast(timescale AS decimal(10, 0))")
    return placed.withColumn("_ticks", ticks.cast("bigint")).select("file_id", "sample", scaled.cast("bigint").alias("t"))


def sync_times(samples: DataFrame, sync: DataFrame) -> DataFrame:
    """TL4: times of the samples that ``sync`` (file_id, sample) lists; of a file without such a table, of all."""
    listed = sync.select("file_id", "sample", F.lit(True).alias("_sync")).distinct()
    has = sync.select("file_id", F.lit(True).alias("_has")).distinct()
    joined = samples.join(has, "file_id", "left").join(listed, ["file_id", "sample"], "left")
    return joined.where(F.col("_has").isNull() | F.col("_sync").isNotNull()).select("file_id", "sample", "t")


def fill_gaps(fragments: DataFrame) -> DataFrame:
    """TL5: a skipped segment takes the next one made, at most four on, within its run."""
    ahead = Window.partitionBy("file_id", "run").orderBy("idx").rowsBetween(0, GAP)
    return fragments.withColumn("serves", F.first("made", ignorenulls=True).over(ahead))


def failure_runs(events: DataFrame, limit: int) -> DataFrame:
    """AG12: runs of failures in a row of ``limit`` or more; a success ends a run.

    A run's number is how many successes came before it, summed over ranges; parts of a run in several
    ranges meet in the last aggregation, each as one row.
    """
    counted = running(events.withColumn("_step", (~F.col("failed")).cast("int")), ["key"], ["seq"], {"_run": "_step"}, SUM)
    return counted.where("failed").groupBy("key", "_run").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where(F.col("n") >= limit).select("key", "first_seq", "n")
