r"""Operator 3: linking quotations, and conversations in reply order without quotes; DataFrame functions only.

A line that starts with ``>`` marks (``>``, ``> >``, ``>>`` ...) is quoted, at the level of their number;
the others are the message's own.  A run is a stretch of lines of one level; passages are its lines, its
sentences (ended by ``.``, ``!`` or ``?``) and the run as a whole, without marks, lower-cased, with white
space as single blanks: a quote that was wrapped anew, or that repeats only a sentence, still meets its
original.  Each quoted passage is linked by its hash to the message of the same conversation that said it
first as its own words, if that came in an earlier turn; a passage counts once per message and level.  A
message answers the message that most of its passages of the lowest linked level come from (of several,
the latest).

``thread`` is the turn of the first message of a thread, ``depth`` the answers between it and the message,
and ``position`` the message's place in reply order: answers below what they answer, earlier answers
first.  Sorted by (conv_id, thread, position), rows are the conversations; :func:`write_conversations`
writes them so.  Places come from the tour around each tree of answers, numbered by doubling: all keys have
a fixed size, and a thread of n messages takes log2(2 n) joins.

A passage's first place is a minimum, pre-aggregated; a passage that everybody quotes is joined in
``SALTS`` parts; brothers are ordered by a range sort, so nothing gathers a conversation or multiplies rows.

Null text is an empty message; rows without a conversation or a turn link with nothing; rows that share
a (conv_id, turn) are parts of one message: they share its links and its place.  A message outside any
thread is one of its own.  A null role is written ``user``.  An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.llm.shared import written

MARKS = r"^((?:[ \t]*>)+)"
#: Parts in which the rows that quote one passage are joined.
SALTS = 16


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def _passage(line: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[ \t\r]+", " ")), F.lit(" "))


def passages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash): what each message says itself (level 0) and quotes, once per level."""
    levels = rows.withColumn("level", F.explode(F.array_distinct(F.transform("lines", _level))))
    # Lines of other levels become a break (U+0001), so that runs end there; U+0002 ends sentences.
    marked = levels.withColumn("marked", F.transform("lines", lambda x: F.when(_level(x) == F.col("level"), _passage(x)).otherwise("\u0001")))
    runs = F.transform(F.split(F.array_join("marked", " "), "\u0001"), lambda r: F.btrim(F.regexp_replace(r, " +", " "), F.lit(" ")))
    marked = marked.withColumn("runs", runs)
    sentences = F.flatten(F.transform("runs", lambda r: F.split(F.regexp_replace(r, "([.!?]) ", "$1\u0002"), "\u0002")))
    every = F.filter(F.array_distinct(F.concat("marked", "runs", sentences)), lambda p: ~p.isin("", "\u0001"))
    return marked.select("conv_id", "turn", "level", F.explode(every).alias("passage")).select("conv_id", "turn", "level", F.xxhash64("passage").alias("hash")).distinct()


def answers_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_linked) of messages that quote earlier ones."""
    said = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = said.where(F.exists("lines", lambda x: _level(x) > 0)).select("conv_id").distinct()
    said = written(passages(said.join(quoting, "conv_id", "left_semi")))
    quoted = said.where("level > 0").withColumn("salt", F.pmod("turn", F.lit(SALTS)))
    firsts = said.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("first"))
    places = quoted.select("conv_id", "hash", "salt").distinct().join(firsts, ["conv_id", "hash"])
    linked = quoted.join(places, ["conv_id", "hash", "salt"]).where("first < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "first").agg(F.count("*").alias("n"))
    best = F.min_by("first", F.struct("level", -F.col("n"), -F.col("first")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("reply_to"), F.sum("n").alias("n_linked"))


def _next_brothers(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, brother): the next answer to the same message, if any, by a range sort."""
    order = ["conv_id", "reply_to", "turn"]
    rows = written(answers.select(*order).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    # One row per partition: where the next one starts.
    starts = rows.groupBy("part").agg(F.min(F.struct(*order)).alias("begin"))
    starts = starts.select("part", F.lead("begin").over(Window.orderBy("part")).alias("after"))
    following = F.lead(F.struct(*order)).over(Window.partitionBy("part").orderBy(*order))
    joined = rows.withColumn("following", following).join(starts, "part").withColumn("following", F.coalesce("following", "after"))
    same = (F.col("following.conv_id") == F.col("conv_id")) & (F.col("following.reply_to") == F.col("reply_to"))
    return joined.select("conv_id", "turn", F.when(same, F.col("following.turn")).alias("brother"))


def threads(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth, position) of every message that answers or is answered."""
    up = answers.select("conv_id", "turn", "reply_to")
    children = up.groupBy("conv_id", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = up.join(_next_brothers(answers), ["conv_id", "turn"]).join(children, ["conv_id", "turn"], "full_outer")
    # The tour enters a message (out = 0), goes through its answers, and leaves it (out = 1).
    enter = nodes.select("conv_id", "turn", F.lit(0).alias("out"), F.coalesce("child", "turn").alias("next"), F.when(F.col("child").isNull(), 1).otherwise(0).alias("next_out"))
    leave = nodes.select("conv_id", "turn", F.lit(1).alias("out"), F.coalesce("brother", "reply_to").alias("next"), F.when(F.col("brother").isNull(), 1).otherwise(0).alias("next_out"))
    # To the tour's end: messages entered, steps down less steps up, and the message that it leaves last.
    tour = enter.union(leave).select("*", (1 - F.col("out")).cast("long").alias("entered"), (1 - 2 * F.col("out")).cast("long").alias("height"), F.col("turn").alias("thread"))
    tour = written(tour)
    while not tour.where("next IS NOT NULL").isEmpty():
        ahead = tour.select("conv_id", F.col("turn").alias("next"), F.col("out").alias("next_out"), F.col("next").alias("next2"), F.col("next_out").alias("out2"), F.col("entered").alias("entered2"), F.col("height").alias("height2"), F.col("thread").alias("thread2"))
        moved = tour.where("next IS NOT NULL").join(ahead, ["conv_id", "next", "next_out"])
        moved = moved.select("conv_id", "turn", "out", F.col("next2").alias("next"), F.col("out2").alias("next_out"), (F.col("entered") + F.col("entered2")).alias("entered"), (F.col("height") + F.col("height2")).alias("height"), F.col("thread2").alias("thread"))
        tour = written(tour.where("next IS NULL").union(moved))
    entered = tour.where("out = 0")
    sizes = entered.where("turn = thread").select("conv_id", "thread", F.col("entered").alias("size"))
    return entered.join(sizes, ["conv_id", "thread"]).select("conv_id", "turn", "thread", (-F.col("height")).alias("depth"), (F.col("size") - F.col("entered")).alias("position"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, n_quotes, n_linked, reply_to, thread, depth, position, clean_text, chat) per message row."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    answers = written(answers_of(rows))
    placed = threads(answers).join(answers, ["conv_id", "turn"], "left")
    clean = F.btrim(F.array_join(F.filter("lines", lambda x: _level(x) == 0), "\n"), F.lit(" \n\r\t"))
    # Rows without a place in a conversation have no key that could part them.
    named = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema if f.name not in rows.columns]
    return rows.where(named).join(placed, ["conv_id", "turn"], "left").unionByName(rows.where(~named).select("*", *none)).select(
        "conv_id",
        "turn",
        "role",
        F.size(F.filter("lines", lambda x: _level(x) > 0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("position", F.lit(0)).cast("long").alias("position"),
        clean.alias("clean_text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), clean).alias("chat"),
    )


def write_conversations(linked: DataFrame, path: str) -> None:
    """Chats as text files in reply order: a range sort, so a conversation of any size is spread over files."""
    order = ["conv_id", "thread", "position", "role", "chat"]
    linked.repartitionByRange(*order).sortWithinPartitions(*order).select("chat").write.option("lineSep", "\n\n").text(path)


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS lines FROM conversations
), s AS (
  SELECT conv_id, turn, list_transform(lines, lambda x: {
    'level': length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')),
    'passage': trim(lower(regexp_replace(regexp_replace(x, '^((?:[ \t]*>)+)', ''), '[ \t\r]+', ' ', 'g')), ' ')}) AS l
  FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND conv_id IN (SELECT conv_id FROM m WHERE len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*>'))) > 0)
), e AS (
  SELECT conv_id, turn, l, unnest(list_distinct(list_transform(l, lambda x: x.level))) AS level FROM s
), k AS (
  SELECT conv_id, turn, level, list_transform(l, lambda x: CASE WHEN x.level = level THEN x.passage ELSE chr(1) END) AS marked FROM e
), r AS (
  SELECT *, list_transform(string_split(array_to_string(marked, ' '), chr(1)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'), ' ')) AS runs FROM k
), u AS (
  SELECT conv_id, turn, level, unnest(list_concat(marked, runs, flatten(list_transform(runs, lambda x: string_split(regexp_replace(x, '([.!?]) ', '\1' || chr(2), 'g'), chr(2)))))) AS passage FROM r
), p AS (
  SELECT DISTINCT * FROM u WHERE passage NOT IN ('', chr(1))
), f AS (
  SELECT conv_id, passage, min(turn) AS first FROM p WHERE level = 0 GROUP BY ALL
), v AS (
  SELECT p.conv_id, p.turn, p.level, f.first, count(*) AS n
  FROM p JOIN f ON p.conv_id = f.conv_id AND p.passage = f.passage AND f.first < p.turn WHERE p.level > 0 GROUP BY ALL
), a AS (
  SELECT conv_id, turn, arg_min(first, (level, -n, -first)) AS reply_to, sum(n) AS n_linked FROM v GROUP BY ALL
), w AS (
  SELECT m.conv_id, m.turn, m.turn AS thread, 0 AS depth, [m.turn] AS path
  FROM (SELECT DISTINCT conv_id, turn FROM m) m ANTI JOIN a ON m.conv_id = a.conv_id AND m.turn = a.turn
  UNION ALL
  SELECT a.conv_id, a.turn, w.thread, w.depth + 1, list_append(w.path, a.turn)
  FROM a JOIN w ON a.conv_id = w.conv_id AND a.reply_to = w.turn
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) - 1 AS position FROM w WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT *, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*>'))) AS n_quotes,
    trim(array_to_string(list_filter(lines, lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), ' ' || chr(10) || chr(13) || chr(9)) AS clean_text
  FROM m
)
SELECT c.conv_id, c.turn, c.role, c.n_quotes::bigint AS n_quotes, coalesce(a.n_linked, 0)::bigint AS n_linked, a.reply_to,
  coalesce(o.thread, c.turn) AS thread, coalesce(o.depth, 0)::bigint AS depth, coalesce(o.position, 0)::bigint AS position, c.clean_text,
  '<|' || coalesce(c.role, 'user') || '|>' || chr(10) || c.clean_text AS chat
FROM c LEFT JOIN a ON c.conv_id = a.conv_id AND c.turn = a.turn LEFT JOIN o ON c.conv_id = o.conv_id AND c.turn = o.turn
"""
