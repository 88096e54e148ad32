"""Queries over time-lines."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from reelframe.operators import timeline as T
from reelframe.plans.registry import query
from reelframe.sources.carriers import carrier, given, with_carriers as sql

_SERIES = "k AS (SELECT file_id, list_sort(list_distinct(list(t_ns))) AS series, max(duration_ns)::bigint AS duration_ns FROM {keyframes} GROUP BY file_id)"
_GREEDY = """s AS (SELECT file_id, duration_ns, list_reduce(list_concat([[0::bigint]], list_transform(series, lambda x: [x])), lambda acc, t: CASE WHEN t[1] >= acc[-1] + 4000000000 AND t[1] + 1000000000 < duration_ns THEN list_append(acc, t[1]) ELSE acc END) AS starts FROM k),
  g AS (SELECT file_id, duration_ns, (generate_subscripts(starts, 1) - 1)::int AS idx, unnest(starts) AS start_ns FROM s)"""
_TIMED = "d AS (SELECT *, greatest(coalesce(lead(start_ns) OVER (PARTITION BY file_id ORDER BY idx), duration_ns) - start_ns, 0) AS length_ns FROM g)"


def _segments(spark, sf_dir):
    return T.segments(T.ordered_keyframes(carrier(spark, sf_dir, "keyframes")))


@query("segments_greedy", sql(f"WITH {_SERIES}, {_GREEDY} SELECT * FROM g"))
def segments_greedy(spark, sf_dir):
    return _segments(spark, sf_dir)


@query("segments_chained", sql(f"WITH {_SERIES}, {_GREEDY} SELECT * FROM g"))
def segments_chained(spark, sf_dir):
    """TL1 by pointers and doubling, for series of any length."""
    return T.chained_segments(carrier(spark, sf_dir, "keyframes"))


@query(
    "uniform_segments",
    sql("""WITH f AS (SELECT file_id, max(duration_ns)::bigint AS duration_ns FROM {keyframes} GROUP BY file_id), u AS (SELECT file_id, duration_ns, unnest(range(0, greatest(duration_ns - 1, 0) + 1, 4000000000)) AS start_ns FROM f)
    SELECT file_id, duration_ns, (row_number() OVER (PARTITION BY file_id ORDER BY start_ns) - 1)::int AS idx, start_ns FROM u WHERE start_ns = 0 OR start_ns + 1000000000 < duration_ns"""),
)
def uniform_segments(spark, sf_dir):
    files = carrier(spark, sf_dir, "keyframes").groupBy("file_id").agg(F.max("duration_ns").alias("duration_ns"))
    return T.segments(files.withColumn("series", F.array().cast("array<bigint>")))


@query("segment_durations", sql(f"WITH {_SERIES}, {_GREEDY}, {_TIMED} SELECT file_id, idx, start_ns, length_ns FROM d"))
def segment_durations(spark, sf_dir):
    return T.durations(_segments(spark, sf_dir)).select("file_id", "idx", "start_ns", "length_ns")


@query("segment_summary", sql(f"WITH {_SERIES}, {_GREEDY}, {_TIMED} SELECT file_id, count(*) AS n, ceil(max(length_ns) / 1000000000)::bigint AS target_s FROM d GROUP BY file_id"))
def segment_summary(spark, sf_dir):
    return T.summary(T.durations(_segments(spark, sf_dir)))


_MOMENTS = "(SELECT DISTINCT user_id AS file_id, (event_id % 40)::bigint * 1000000000 - 1000000 AS t_ns FROM events)"


@query("asof_segment", sql(f"WITH {_SERIES}, {_GREEDY} SELECT p.file_id, p.t_ns, coalesce(max(idx) FILTER (WHERE start_ns <= p.t_ns + 2000000), 0)::int AS segment FROM {_MOMENTS} p LEFT JOIN g ON g.file_id = p.file_id GROUP BY ALL"))
def asof_segment(spark, sf_dir):
    moments = given(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), ((F.col("event_id") % 40) * 1000000000 - 1000000).alias("t_ns")).distinct()
    return T.segment_of(_segments(spark, sf_dir), moments)


_CHAPTERS = "(SELECT conv_id AS file_id, turn * 10 AS start_s, CASE WHEN turn % 3 = 0 THEN turn * 10 ELSE turn * 10 + 8 END AS end_s, 'c' || turn AS title, CASE WHEN conv_id % 2 = 0 THEN 75 END::bigint AS duration_s FROM conversations)"
_CLOSED = f"(SELECT file_id, start_s, CASE WHEN end_s > start_s THEN end_s ELSE coalesce(lead(start_s) OVER (PARTITION BY file_id ORDER BY start_s, title), duration_s, start_s) END AS end_s, title, duration_s FROM {_CHAPTERS})"


def _chapters(spark, sf_dir):
    start = F.col("turn") * 10
    rows = given(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("file_id"), start.alias("start_s"), F.when(F.col("turn") % 3 == 0, start).otherwise(start + 8).alias("end_s"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("title"), F.when(F.col("conv_id") % 2 == 0, F.lit(75).cast("bigint")).alias("duration_s"))


@query("chapters_closed", f"SELECT * FROM {_CLOSED}")
def chapters_closed(spark, sf_dir):
    return T.closed_chapters(_chapters(spark, sf_dir))


@query(
    "chapter_at",
    f"""WITH c AS {_CLOSED}, m AS (SELECT file_id, arg_max(struct_pack(title, start_s, end_s), (start_s, title)) AS last FROM c GROUP BY file_id HAVING count(*) > 1 AND max(duration_s) > 0),
    p AS (SELECT file_id, last, unnest([3, 19, 64])::bigint AS t FROM m), h AS (SELECT p.file_id, p.t, arg_min(struct_pack(title, start_s, end_s), (start_s, title)) AS c FROM p JOIN c ON c.file_id = p.file_id AND p.t >= start_s AND p.t < end_s GROUP BY ALL),
    f AS (SELECT p.file_id, p.t, coalesce(h.c, CASE WHEN p.t >= p.last.start_s THEN p.last END) AS c FROM p LEFT JOIN h ON h.file_id = p.file_id AND h.t = p.t)
    SELECT file_id, t, c.title AS title, round(CASE WHEN c.end_s > c.start_s THEN greatest(0::double, least(1::double, (t - c.start_s) / (c.end_s - c.start_s)::double)) WHEN c IS NOT NULL THEN 0::double END, 6) AS fraction FROM f""",
)
def chapter_at(spark, sf_dir):
    chapters = T.closed_chapters(_chapters(spark, sf_dir))
    points = chapters.select("file_id").distinct().select("file_id", F.explode(F.array(F.lit(3), F.lit(19), F.lit(64)).cast("array<bigint>")).alias("t"))
    return T.chapter_at(chapters, points)


@query("piece_buckets", sql("WITH n AS (SELECT *, max(piece) OVER (PARTITION BY file_id) + 1 AS n FROM {pieces}) SELECT file_id, (((piece + 1) * least(200, n) - 1) // n)::bigint AS bucket, (sum(have::bigint) * 255 // count(*))::bigint AS level FROM n GROUP BY ALL"))
def piece_buckets(spark, sf_dir):
    return T.piece_buckets(carrier(spark, sf_dir, "pieces"))


@query("piece_buckets_empty", sql("SELECT DISTINCT l_partkey AS file_id, unnest(range(200))::bigint AS bucket, 0::bigint AS level FROM lineitem"))
def piece_buckets_empty(spark, sf_dir):
    return T.without_pieces(given(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id")).distinct())


_RUNS = "(SELECT conv_id AS file_id, turn AS run, 1 + length(text) % 5 AS n, 10 + turn AS delta FROM conversations)"


@query(
    "rle_expand",
    f"""WITH r AS (SELECT *, coalesce(sum(n * delta) OVER w, 0) AS base, coalesce(sum(n) OVER w, 0) AS first FROM {_RUNS} WINDOW w AS (PARTITION BY file_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT file_id, base, first, delta, unnest(range(n)) AS k FROM r)
    SELECT file_id, (first + k)::bigint AS sample, greatest(base + k * delta + CASE WHEN (first + k) % 4 = 0 THEN -15 ELSE 0 END, 0)::bigint AS t FROM x""",
)
def rle_expand(spark, sf_dir):
    runs = given(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("run"), (1 + F.length("text") % 5).cast("bigint").alias("n"), (10 + F.col("turn")).alias("delta"))
    total = runs.groupBy("file_id").agg(F.sum("n").alias("total"))
    shifts = total.select("file_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(4).cast("bigint"))).alias("sample")).withColumn("shift", F.lit(-15).cast("bigint"))
    return T.expand_runs(runs, shifts)


@query(
    "presentation_times",
    f"""WITH r AS (SELECT *, coalesce(sum(n * delta) OVER w, 0) AS base, coalesce(sum(n) OVER w, 0) AS first FROM {_RUNS} WINDOW w AS (PARTITION BY file_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT file_id, base, first, delta, unnest(range(n)) AS k FROM r), o AS (SELECT file_id, first + k AS sample, delta % 7 - 3 AS shift FROM x WHERE first + k < 9)
    SELECT x.file_id, (first + k)::bigint AS sample, (greatest(base + k * delta + coalesce(shift, 0) - CASE WHEN x.file_id % 2 = 0 THEN 12 ELSE 0 END, 0)::hugeint * 1000000000 // (24 + x.file_id % 3))::bigint AS t FROM x LEFT JOIN o ON o.file_id = x.file_id AND o.sample = first + k""",
)
def presentation_times(spark, sf_dir):
    """TL4: tables of decode steps, composition offsets of the first samples, and edit lists, as times in ns."""
    runs = given(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("run"), (1 + F.length("text") % 5).cast("bigint").alias("n"), (10 + F.col("turn")).alias("delta"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.withColumn("before", before).select("file_id", "run", F.greatest(F.least("n", F.lit(9) - F.col("before")), F.lit(0)).alias("n"), (F.col("delta") % 7 - 3).alias("offset"))
    tracks = runs.select("file_id").distinct().select("file_id", F.when(F.col("file_id") % 2 == 0, 12).alias("media_time"), (24 + F.col("file_id") % 3).alias("timescale"))
    return T.presentation_times(runs, offsets, tracks)


@query("run_fill", "SELECT conv_id AS file_id, role AS run, turn AS idx, first_value(CASE WHEN length(text) % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS serves FROM conversations")
def run_fill(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("role").alias("run"), F.col("turn").alias("idx"), F.when(F.length("text") % 3 == 0, F.col("turn")).alias("made"))
    return T.fill_gaps(rows).drop("made")


@query(
    "failure_runs",
    """WITH e AS (SELECT user_id AS key, event_id AS seq, event_type IN ('error', 'click') AS failed FROM events), i AS (SELECT *, sum((NOT failed)::int) OVER (PARTITION BY key ORDER BY seq) AS island FROM e)
    SELECT key, min(seq) AS first_seq, count(*) AS n FROM i WHERE failed GROUP BY key, island HAVING count(*) >= 4""",
)
def failure_runs(spark, sf_dir):
    events = given(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").isin("error", "click").alias("failed"))
    return T.failure_runs(events, 4)
