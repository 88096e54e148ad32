"""Queries of the subtitle-corpus job."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.functions import subtitles as T
from reelframe.operators import subtitles as O
from reelframe.plans.registry import query
from reelframe.sources.carriers import carrier, dealt, given, with_carriers as sql
from reelframe.sources.files import EACH_TASK_MOVES, storage_files, subtitle_files
from reelframe.sources.workspace import shared_path

_WS = "' ' || chr(10) || chr(9) || chr(13)"
_SECONDS = lambda t: f"(CASE WHEN len(string_split({t}, ':')) = 3 THEN try_cast(string_split(replace(trim({t}), ',', '.'), ':')[1] AS double) * 3600 + try_cast(string_split(replace(trim({t}), ',', '.'), ':')[2] AS double) * 60 + try_cast(string_split(replace(trim({t}), ',', '.'), ':')[3] AS double) END)"


_FOLD = """list_reduce(list_concat([{'s': 0, 'p': 0, 'o': '', 'c': ''}], list_transform(string_split(line, ''), lambda ch: {'s': 0, 'p': 0, 'o': '', 'c': ch})), lambda a, x: {
  's': CASE x.c WHEN '[' THEN a.s + 1 WHEN ']' THEN greatest(a.s - 1, 0) ELSE a.s END,
  'p': CASE x.c WHEN '(' THEN a.p + 1 WHEN ')' THEN greatest(a.p - 1, 0) ELSE a.p END,
  'o': CASE WHEN x.c NOT IN ('[', ']', '(', ')') AND a.s = 0 AND a.p = 0 THEN a.o || x.c ELSE a.o END, 'c': ''}).o"""


#: A message without sounds, labels and notes, line by line.
_CLEAN = lambda text: f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda line: trim(regexp_replace(trim({_FOLD}, ' ' || chr(9) || chr(13)), '^[A-Z -]+:', ''), ' ' || chr(9) || chr(13))), lambda x: NOT regexp_matches(x, '^[♪♫#~ ]*$')), chr(10))"

_TIMES = "list_transform(string_split(ls[2], '-->'), lambda x: trim(x, " + _WS + "))"
_CUE_SQL = rf"""WITH b AS (SELECT conv_id, turn, list_transform(string_split(replace(regexp_replace(content, '^' || chr(65279), ''), chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: trim(x, {_WS})) AS bs FROM {{srt_files}}),
    l AS (SELECT conv_id, turn, generate_subscripts(bs, 1) AS k, string_split(unnest(bs), chr(10)) AS ls FROM b), p AS (SELECT *, {_TIMES} AS ts FROM l WHERE len(ls) >= 3),
    t AS (SELECT conv_id, turn, k, {_SECONDS("ts[1]")} AS start, {_SECONDS("ts[2]")} AS "end", trim(replace(regexp_replace(array_to_string(ls[3:], chr(10)), '<[^>]*(>|$)', '', 'g'), '>', ''), {_WS}) AS plain FROM p WHERE len(ts) = 2),
    c AS (SELECT *, {_CLEAN("plain")} AS text FROM t WHERE start IS NOT NULL AND "end" IS NOT NULL)
    SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1)::int AS idx, round(start, 6) AS start, round("end", 6) AS "end", text FROM c WHERE text <> ''"""


def _cues(spark, sf_dir, files):
    cues = O.explode_cues(carrier(spark, sf_dir, files), "conv_id", "turn")
    return cues.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("cue_explode", sql(_CUE_SQL))
def cue_explode(spark, sf_dir):
    return _cues(spark, sf_dir, "srt_files")


@query("cue_explode_whole", sql(_CUE_SQL.replace("{srt_files}", "{srt_whole}")))
def cue_explode_whole(spark, sf_dir):
    """SB1-SB3 over whole messages."""
    return _cues(spark, sf_dir, "srt_whole")


_SDH_SQL = f"""WITH w AS (SELECT conv_id, turn, 'JOHN DOE: ' || text || ' (sighs) [door' || chr(10) || '♪ ~ ♪' || chr(10) || 'MAN: ] ' || @second@ || '[a (b] c) d' AS text FROM conversations),
    l AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM w),
    f AS (SELECT conv_id, turn, k, trim(regexp_replace(trim({_FOLD}, ' ' || chr(9) || chr(13)), '^[A-Z -]+:', ''), ' ' || chr(9) || chr(13)) AS line FROM l)
    SELECT w.conv_id, w.turn, coalesce((SELECT string_agg(line, chr(10) ORDER BY k) FROM f WHERE f.conv_id = w.conv_id AND f.turn = w.turn AND NOT regexp_matches(line, '^[♪♫#~ ]*$')), '') AS text FROM w"""


def _cleaned(spark, sf_dir, first, second):
    text = F.concat(F.lit("JOHN DOE: "), first, F.lit(" (sighs) [door\n♪ ~ ♪\nMAN: ] "), second, F.lit("[a (b] c) d"))
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_sdh(text).alias("text"))


@query("sdh_clean", sql(_SDH_SQL.replace("@second@", "role")))
def sdh_clean(spark, sf_dir):
    """SB4: a speaker's label, the whole message, sounds, notes and the role."""
    return _cleaned(spark, sf_dir, F.col("text"), F.col("role"))


@query("sdh_clean_whole", sql(_SDH_SQL.replace("@second@", "text")))
def sdh_clean_whole(spark, sf_dir):
    """SB4 over whole messages, twice each."""
    return _cleaned(spark, sf_dir, F.col("text"), F.col("text"))


@query(
    "tag_strip",
    rf"""SELECT page_id, trim(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', ''), {_WS}) AS plain, trim(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), {_WS}) AS embedded,
    replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS unescaped FROM pages""",
)
def tag_strip(spark, sf_dir):
    html = F.col("html")
    return given(spark, sf_dir, "pages").select("page_id", T.strip_tags(html).alias("plain"), T.strip_tags_embedded(html).alias("embedded"), T.unescape(html).alias("unescaped"))


def _events(spark, sf_dir, text):
    event = F.concat(F.col("turn").cast("string"), F.lit(r",0,Default,,0,0,0,,{\i1}"), text, F.lit(r", a\Nb\hc{x}"))
    end = T.cue_end(F.col("turn").cast("double"), F.when(F.col("turn") % 2 != 0, 1.5))
    return given(spark, sf_dir, "conversations").select("conv_id", "turn", T.ass_text(event).alias("text"), end.alias("end"))


_DEPTH = """list_reduce(list_concat([{'d': 0, 'o': '', 'c': ''}], list_transform(string_split(text, ''), lambda ch: {'d': 0, 'o': '', 'c': ch})), lambda a, x: {
  'd': CASE x.c WHEN '{' THEN a.d + 1 WHEN '}' THEN greatest(a.d - 1, 0) ELSE a.d END,
  'o': CASE WHEN a.d = 0 AND x.c <> '{' THEN a.o || x.c ELSE a.o END, 'c': ''})"""


@query(
    "ass_text_whole",
    f"""WITH f AS (SELECT conv_id, turn, {_DEPTH} AS f FROM conversations),
    t AS (SELECT conv_id, turn, CASE WHEN f.d = 0 THEN f.o || ', a' || '\\Nb\\hc' ELSE f.o END AS text FROM f)
    SELECT conv_id, turn, replace(replace(replace(text, '\\N', chr(10)), '\\n', chr(10)), '\\h', ' ') AS text, turn + CASE WHEN turn % 2 = 0 THEN 3.0::double ELSE 1.5::double END AS "end" FROM t""",
)
def ass_text_whole(spark, sf_dir):
    """SB6, SB7: event lines that hold whole messages, braces, escapes and all; one that ends inside braces hides what follows."""
    return _events(spark, sf_dir, F.col("text"))


def points(spark, sf_dir):
    """Three moments per track: inside, between and past its cues."""
    return carrier(spark, sf_dir, "cues").select("track_id").distinct().select("track_id", F.explode(F.array(F.lit(1), F.lit(7), F.lit(500)).cast("array<bigint>")).alias("t"))


_POINTS = "(SELECT DISTINCT track_id, unnest([1, 7, 500])::bigint AS t FROM {cues})"


@query("cue_at", sql(f"SELECT p.track_id, p.t, min(idx) AS idx FROM {_POINTS} p LEFT JOIN {{cues}} c ON c.track_id = p.track_id AND p.t BETWEEN start_s AND end_s GROUP BY p.track_id, p.t"))
def cue_at(spark, sf_dir):
    return O.cue_at(carrier(spark, sf_dir, "cues"), points(spark, sf_dir))


@query(
    "cue_neighbours",
    sql(f"""WITH a AS (SELECT *, lag(text) OVER (PARTITION BY track_id ORDER BY idx) AS previous, lead(text) OVER (PARTITION BY track_id ORDER BY idx) AS next FROM {{cues}}),
    c AS (SELECT p.track_id, p.t, coalesce(min(idx) FILTER (WHERE p.t BETWEEN start_s AND end_s), min(idx) FILTER (WHERE start_s > p.t)) AS found, coalesce(found, min(idx))::bigint AS idx FROM {_POINTS} p JOIN {{cues}} c ON c.track_id = p.track_id GROUP BY p.track_id, p.t)
    SELECT c.track_id, c.t, c.idx, CASE WHEN found IS NOT NULL THEN previous END AS previous, text AS current, CASE WHEN found IS NOT NULL THEN next END AS next FROM c JOIN a ON a.track_id = c.track_id AND a.idx = c.idx"""),
)
def cue_neighbours(spark, sf_dir):
    return O.neighbours(carrier(spark, sf_dir, "cues"), points(spark, sf_dir))


@query("dup_labels", "SELECT conv_id, turn, role || CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN ' #' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE '' END AS label FROM conversations")
def dup_labels(spark, sf_dir):
    return O.duplicate_labels(given(spark, sf_dir, "conversations"), ["conv_id", "role"], F.col("role"), "turn").select("conv_id", "turn", "label")


@query(
    "vtt_export",
    sql("""WITH l AS (SELECT track_id, idx, printf('%02d:%02d:%02d.000', start_s // 3600, start_s // 60 % 60, start_s % 60) || ' --> ' || printf('%02d:%02d:%02d.000', end_s // 3600, end_s // 60 % 60, end_s % 60) || chr(10) || replace(replace(text, '&', '&amp;'), '<', '&lt;') || chr(10) AS line FROM {cues})
    SELECT track_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY idx) AS value FROM l GROUP BY track_id"""),
)
def vtt_export(spark, sf_dir):
    return O.export_vtt(carrier(spark, sf_dir, "cues"))


@query(
    "vtt_lines",
    sql("""SELECT track_id, idx, printf('%02d:%02d:%02d.000', start_s // 3600, start_s // 60 % 60, start_s % 60) || ' --> ' || printf('%02d:%02d:%02d.000', end_s // 3600, end_s // 60 % 60, end_s % 60) || chr(10) || replace(replace(text, '&', '&amp;'), '<', '&lt;') || chr(10) AS value FROM {cues}
    UNION ALL SELECT DISTINCT track_id, -1, 'WEBVTT' || chr(10) FROM {cues}"""),
)
def vtt_lines(spark, sf_dir):
    """SC11: the pieces of each track's document, of which ``sources.files.write_vtt`` makes files."""
    return O.vtt_lines(carrier(spark, sf_dir, "cues"))


@query(
    "subtitle_corpus",
    """SELECT 0 AS idx, 1::double AS start, 2.5::double AS "end", s_name AS text FROM supplier
    UNION ALL SELECT 1, 63::double, 64::double, 'supplier ' || s_suppkey || ' of ' || s_nationkey FROM supplier""",
)
def subtitle_corpus(spark, sf_dir):
    """SC7: one subtitle file per supplier, written, then read as a corpus of whole files."""
    path = shared_path(spark, "corpus")
    cues = F.format_string("1\n00:00:01,000 --> 00:00:02,500\n%s\n\n2\n00:01:03,000 --> 00:01:04,000\n<b>supplier %d</b> of %d", "s_name", "s_suppkey", "s_nationkey")
    dealt(given(spark, sf_dir, "supplier")).select(cues.alias("value")).write.options(**EACH_TASK_MOVES).option("maxRecordsPerFile", 1).text(path)
    return O.explode_cues(subtitle_files(spark, path)).select("idx", "start", "end", "text")


@query("storage_listing", "SELECT c_nationkey::bigint AS nation, c_mktsegment AS segment, 1::bigint AS n_files, sum(strlen(c_name) + 1)::bigint AS bytes, 2::bigint AS depth FROM customer GROUP BY ALL")
def storage_listing(spark, sf_dir):
    """SC9: the regular files of a tree of folders that was written before, with their bytes and depth; their content isn't read."""
    path = shared_path(spark, "storage")
    rows = given(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.col("c_name").alias("value"))
    rows.repartition("c_nationkey", "c_mktsegment").write.partitionBy("c_nationkey", "c_mktsegment").text(path)
    below = F.split(F.regexp_extract("path", f"/{path.rsplit('/', 1)[1]}/(.*)", 1), "/")
    files = storage_files(spark, path).select("length", below.alias("names")).where("size(names) > 1")
    value = lambda k: F.url_decode(F.substring_index(F.col("names")[k], "=", -1))
    grouped = files.groupBy(value(0).cast("long").alias("nation"), value(1).alias("segment"))
    return grouped.agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"), (F.max(F.size("names")) - 1).cast("long").alias("depth"))


def _tracks(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations")
    language = F.when(F.col("turn") % 4 == 0, "en").when(F.col("turn") % 4 == 1, "fr").when(F.col("turn") % 4 == 2, "xx")
    return rows.select((F.col("conv_id") * 10 + F.col("turn")).alias("track_id"), "conv_id", language.alias("language"), F.when(F.col("conv_id") % 3 != 0, F.col("turn").cast("string")).otherwise("n/a").alias("score"), F.length("text").cast("bigint").alias("n_cues"))


_TRACKS = "(SELECT conv_id * 10 + turn AS track_id, conv_id, CASE turn % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' END AS language, CASE WHEN conv_id % 3 <> 0 THEN turn ELSE 0 END AS score, length(text) AS n_cues FROM conversations)"


@query("track_select", f"SELECT track_id, CASE language WHEN 'en' THEN 'eng' ELSE 'fre' END AS code, score::bigint AS score FROM {_TRACKS} WHERE language IN ('en', 'fr')")
def track_select(spark, sf_dir):
    return O.select_tracks(_tracks(spark, sf_dir), ["eng", "fre"]).select("track_id", "code", "score")


@query(
    "track_union",
    f"""WITH u AS (SELECT track_id, conv_id, coalesce(language, 'und') AS language, 1000::bigint AS score, n_cues, 0 AS rank FROM {_TRACKS} WHERE track_id % 2 = 0 AND n_cues > 0
    UNION ALL SELECT track_id, conv_id, language, score, n_cues, 1 FROM {_TRACKS} WHERE track_id % 2 = 1 AND n_cues > 0)
    SELECT conv_id, arg_min(track_id, (rank, -score, track_id)) AS track_id FROM u GROUP BY conv_id""",
)
def track_union(spark, sf_dir):
    """SO3, AG13: embedded before external; the first that has cues."""
    tracks = _tracks(spark, sf_dir).withColumn("score", F.coalesce(F.col("score").try_cast("bigint"), F.lit(0).cast("bigint")))
    return O.first_non_empty(O.union_tracks(tracks.where("track_id % 2 = 0"), tracks.where("track_id % 2 = 1")), "conv_id")
