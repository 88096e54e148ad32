"""Domain tables derived from the given tables, each by one SQL text that Spark and DuckDB read alike.

The texts use ``||``, ``chr``, ``CASE`` and integer casts only, and never print a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

LISTINGS = """
SELECT cast(l_suppkey % 3 AS int) AS source_idx,
  CASE l_suppkey % 3 WHEN 0 THEN 'https://torrentio.example.org/a' WHEN 1 THEN 'http://media.example.org/b' ELSE 'torr.example.org/c' END AS source_url,
  cast(l_partkey * 10 + l_linenumber AS bigint) * 1000000 + l_suppkey * 100 + cast(l_quantity AS int) AS pos,
  'h' || cast(l_orderkey AS varchar(20)) AS info_hash,
  l_linenumber AS file_idx,
  CASE p_size % 7 WHEN 0 THEN 'Source' || chr(10) || '4k HDR' WHEN 1 THEN 'x 1080p' WHEN 2 THEN 'plain' WHEN 3 THEN 'x 720p 480p' WHEN 4 THEN 'y 1440p' WHEN 5 THEN 'z 2160p | imax' ELSE 'w 480p' END AS name,
  p_name || CASE p_type WHEN 'ECONOMY' THEN ' DVDRip AAC2.0' WHEN 'SMALL' THEN ' WEB-DL DDP5.1' WHEN 'MEDIUM' THEN ' the Camera ac3' WHEN 'PROMO' THEN ' BluRay REMUX TrueHD Dolby Vision' WHEN 'STANDARD' THEN ' webrip x264' ELSE ' hdtv' END
    || chr(10) || CASE cast(l_quantity AS int) % 9 WHEN 0 THEN 'no seeds' WHEN 1 THEN '👤 99999999999' ELSE '👤 ' || cast(cast(l_quantity AS int) AS varchar(20)) END
    || ' 💾 ' || CASE cast(l_quantity AS int) % 5 WHEN 0 THEN 'abc GB' || chr(10) || '💾 2 PB z' WHEN 1 THEN cast(p_size * 2 AS varchar(20)) || ' GB' WHEN 2 THEN cast(p_size AS varchar(20)) || '.5 GB' WHEN 3 THEN cast(p_size * 20 AS varchar(20)) || ' mb' ELSE '1.25 TB' END || ' ⚙️ s' AS title,
  CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'src|1080p|BluRay' WHEN 2 THEN 'a|dvdrip' ELSE 'b| 4k |hevc' END AS binge_group,
  CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN p_name || '.x265.EAC3.mkv' WHEN 2 THEN p_name || '.H.264.mkv' ELSE p_name || '.av1.opus.mkv' END AS filename
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

MEDIA_ITEMS = """
SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'tv' ELSE 'movie' END AS media_type, p_partkey + 1000 AS tmdb_id, p_name AS title,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE '/' || p_brand || '.jpg' END AS poster_path
FROM part
"""

DOWNLOADS = """
SELECT o_orderkey AS id, 'h' || cast(o_orderkey AS varchar(20)) AS info_hash, cast(o_orderkey % 3 AS int) AS file_idx, 'file ' || cast(o_orderkey AS varchar(20)) AS name,
  cast(floor(o_totalprice * 100) AS bigint) AS total_bytes, cast(floor(o_totalprice * 100) AS bigint) * (o_custkey % 5) / 4 AS grown,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_custkey % 2 = 0 THEN 'queued' ELSE 'downloading' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'paused' WHEN o_custkey % 3 = 1 THEN 'failed' ELSE 'cancelled' END END AS status,
  o_orderdate AS created_at
FROM orders
"""

DOWNLOAD_META = """
SELECT 'h' || cast(l_orderkey AS varchar(20)) AS info_hash, cast(l_orderkey % 3 AS int) AS file_idx, max(l_partkey) AS media_id,
  CASE WHEN max(l_partkey) % 3 = 0 THEN max(l_linenumber) END AS season, CASE WHEN max(l_partkey) % 3 = 0 THEN min(l_linenumber) END AS episode,
  CASE max(l_linenumber) WHEN 1 THEN '720p' WHEN 2 THEN '1080p' ELSE NULL END AS resolution
FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey
"""

JOBS = """
SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS download_id, cast(min(l_suppkey) % 3 AS int) AS audio_index, min(l_suppkey) % 2 = 0 AS only_audio,
  min(l_partkey) * 100 AS transcoded_ms, max(l_partkey) * 100 AS total_ms,
  CASE min(l_returnflag) WHEN 'A' THEN 'completed' WHEN 'N' THEN 'queued' ELSE CASE WHEN min(l_linestatus) = 'F' THEN 'transcoding' ELSE 'paused' END END AS status,
  min(l_shipdate) AS created_at
FROM lineitem GROUP BY l_orderkey, l_linenumber
"""

#: Files of finished jobs; a third of all jobs have none.
OUTPUTS = """
SELECT path, max(total_ms) AS length FROM (
  SELECT 'pretranscoded/' || cast(l_orderkey AS varchar(20)) || CASE WHEN min(l_suppkey) % 2 = 0 THEN '_audio_' ELSE '_full_' END || cast(cast(min(l_suppkey) % 3 AS int) AS varchar(20)) || '.mp4' AS path, max(l_partkey) * 100 AS total_ms, l_orderkey * 8 + l_linenumber AS id
  FROM lineitem GROUP BY l_orderkey, l_linenumber
) AS o WHERE id % 3 <> 0 GROUP BY path
"""

ONE_JOBS = """
SELECT l_orderkey AS id, CASE max(l_linenumber) WHEN 7 THEN 'queued' WHEN 6 THEN 'transcoding' WHEN 5 THEN 'paused' WHEN 4 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'cancelled' END AS status
FROM lineitem GROUP BY l_orderkey
"""

WATCH = """
SELECT event_id AS seq, user_id AS media_id, event_id % 97 AS download_id, ts AS seen_at, event_type AS kind, cast(floor(value * 10) AS bigint) AS position, 600 + user_id * 7 AS duration
FROM events
"""

#: Heartbeats of films and of episodes; some of a series lack their episode.
WATCH_EPISODES = """
SELECT event_id AS seq, user_id AS media_id, CASE WHEN user_id % 3 = 0 THEN 'tv' ELSE 'movie' END AS media_type, CASE WHEN user_id % 3 = 0 THEN event_id % 2 + 1 END AS season,
  CASE WHEN user_id % 3 = 0 AND event_id % 11 <> 0 THEN event_id % 4 + 1 END AS episode, ts AS seen_at, cast(floor(value * 10) AS bigint) AS position, 600 + user_id * 7 AS duration
FROM events
"""

STORAGE_FILES = """
SELECT CASE l_linenumber % 3 WHEN 0 THEN '/data/transcodings/' WHEN 1 THEN '/data/downloads/' ELSE '/data/artwork/' END || 'H' || cast(l_orderkey AS varchar(20)) || '/f' || cast(l_linenumber AS varchar(20)) || '_' || cast(l_partkey AS varchar(20)) AS path,
  cast(floor(l_extendedprice) AS bigint) AS length
FROM lineitem
"""

SEARCH_HITS = """
SELECT cast(p_size % 3 AS int) AS list_idx, p_partkey AS pos, p_partkey % 211 AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'tv' WHEN p_partkey % 4 = 2 THEN 'person' ELSE 'movie' END AS media_type,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '20' || cast(10 + p_size % 50 AS varchar(20)) || '-01-05' END AS release_date, CASE WHEN p_partkey % 6 = 0 THEN '19' || cast(10 + p_size % 50 AS varchar(20)) || '-03-01' END AS first_air_date
FROM part
"""

IMAGES = """
SELECT l_partkey AS id, l_orderkey * 10000 + l_linenumber * 1000 + l_suppkey % 1000 AS pos, '/' || cast(l_orderkey % 50 AS varchar(20)) || '.jpg' AS file_path,
  600 + (l_suppkey % 40) * 50 AS width, CASE l_linenumber % 3 WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'fr' END AS lang, cast(l_quantity AS int) AS votes
FROM lineitem
"""

SRT_FILES = """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN chr(65279) ELSE '' END || '1' || chr(13) || chr(10) || '00:00:01,000 --> 00:00:0' || cast(2 + turn % 7 AS varchar(20)) || ',500' || chr(13) || chr(10) || '<i>' || text || '</i>'
  || chr(10) || chr(10) || '2' || chr(10) || '00:0' || cast(turn % 10 AS varchar(20)) || ':05,250 --> 00:1' || cast(turn % 10 AS varchar(20)) || ':07.800' || chr(10) || 'WOMAN: [sighs] ' || role || chr(10) || '(door (closes)) ' || text
  || chr(10) || chr(10) || '3' || chr(10) || 'not a time' || chr(10) || 'skipped' AS content
FROM conversations
"""

#: Every message whole: as one cue, and again with a cue for each of its lines.
SRT_WHOLE = """
SELECT conv_id, turn, '1' || chr(13) || chr(10) || '00:00:01,000 --> 00:00:0' || cast(2 + turn % 7 AS varchar(20)) || ',500' || chr(13) || chr(10) || '<i>' || text || '</i>'
  || chr(10) || chr(10) || '2' || chr(10) || '00:0' || cast(turn % 10 AS varchar(20)) || ':05,250 --> 00:1' || cast(turn % 10 AS varchar(20)) || ':07.800' || chr(10) || 'WOMAN: [sighs] '
  || replace(text, chr(10), chr(10) || chr(10) || '3' || chr(10) || '00:0' || cast(turn % 10 AS varchar(20)) || ':08,250 --> 00:1' || cast(turn % 10 AS varchar(20)) || ':09.800' || chr(10) || '(door (closes)) ')
  || chr(10) || chr(10) || '4' || chr(10) || 'not a time' || chr(10) || 'skipped' AS content
FROM conversations
"""

CUES = """
SELECT conv_id AS track_id, turn AS idx, turn * 4 AS start_s, turn * 4 + 2 + conv_id % 4 AS end_s, text FROM conversations
"""

KEYFRAMES = """
SELECT user_id AS file_id, cast(epoch_s AS bigint) * 1000000000 AS t_ns, 40000000000 + (user_id % 7) * 500000000 AS duration_ns
FROM (SELECT user_id, event_id % 41 AS epoch_s FROM events)
"""

PIECES = """
SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS piece, l_returnflag = 'N' AS have FROM lineitem
"""

MEDIA_FILES = """
SELECT p_partkey AS file_id, CASE p_size % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'matroska' WHEN 2 THEN 'webm' ELSE 'mov' END AS container,
  CASE p_size % 5 WHEN 0 THEN 'h264' WHEN 1 THEN 'hevc' WHEN 2 THEN 'AV1' WHEN 3 THEN 'H264' ELSE 'vp9' END AS video_codec,
  CASE WHEN p_partkey % 11 = 0 THEN 10 ELSE 8 END AS bit_depth, CASE WHEN p_partkey % 13 = 0 THEN '4:4:4' WHEN p_partkey % 13 = 1 THEN NULL ELSE '4:2:0' END AS chroma, p_partkey % 6 = 0 AS hdr,
  CASE p_size % 3 WHEN 0 THEN 720 WHEN 1 THEN 1080 ELSE 2160 END AS height,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'aac' WHEN 2 THEN 'eac3' ELSE 'opus' END AS audio_0, CASE p_partkey % 3 WHEN 0 THEN 'aac' WHEN 1 THEN 'dts' ELSE NULL END AS audio_1,
  CASE WHEN p_partkey % 6 = 1 THEN 'flac' END AS audio_2
FROM part
"""

CLIENTS = """
SELECT * FROM (VALUES ('browser', 'h264,vp9', 'aac,opus', 'mp4,webm', 1080), ('television', 'h264,hevc', 'aac,eac3', 'mp4', 2160), ('any', 'h264,hevc,av1,vp9', 'aac,eac3,opus,dts', 'mp4,matroska,webm,mov', 4320), ('unlimited', 'h264,hevc', 'aac,flac', 'mp4,mov', NULL)) AS c(client_id, video_codecs, audio_codecs, containers, max_height)
"""

PIXELS = """
SELECT l_orderkey % 300 AS image_id, cast(l_linenumber AS int) AS y, cast(l_suppkey % 16 AS int) AS x, cast(l_quantity * 5 AS int) % 256 AS r, cast(l_partkey * 7 % 256 AS int) AS g, cast((l_suppkey * 13) % 256 AS int) AS b FROM lineitem
"""

PEERS = """
SELECT c_custkey AS client_id, c_nationkey AS room, cast(floor(abs(c_acctbal)) AS int) % 2000 AS width, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'remote' ELSE 'player' END AS mode, c_custkey - c_custkey % 10 AS paired_to FROM customer
"""

CARRIERS = {k.lower(): v for k, v in globals().items() if k.isupper() and isinstance(v, str) and k != "TABLES"}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to all cores where their scan has fewer parts: a small file of one row group is read by one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def carrier(spark: SparkSession, sf_dir: str, name: str, deal: str | None = None) -> DataFrame:
    """A domain table; Catalyst prunes and pushes into the scans below it. Table ``deal`` is dealt to all cores."""
    text = CARRIERS[name]
    used = [t for t in TABLES if f" {t} " in " " + text.replace("\n", " ").replace(")", " ") + " "]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    tables = {t: dealt(given(spark, sf_dir, t)) if t == deal else given(spark, sf_dir, t) for t in used}
    return spark.sql(text, **tables) if used else spark.sql(text)


def with_carriers(sql: str) -> str:
    """``sql`` with the carriers that it names (``{listings}``) as common table expressions, for DuckDB."""
    used = [c for c in CARRIERS if "{" + c + "}" in sql]
    for c in used:
        sql = sql.replace("{" + c + "}", c)
    if not used:
        return sql
    heads = ",\n".join(f"{c} AS ({CARRIERS[c].strip()})" for c in used)
    body = sql.strip()
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start):
            return f"{start} {heads},\n{body[len(start) :].strip()}"
    return f"WITH {heads}\n{body}"
