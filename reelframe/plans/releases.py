"""Queries of the release-ranking job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelframe.operators import releases
from reelframe.plans.registry import query
from reelframe.sources.carriers import carrier, with_carriers


def _case(column: str, rules: list[tuple[str, list[str]]]) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({column}, '{p}')''' for p in patterns)} THEN '{label}'" for label, patterns in rules) + " END"


def _weight(column: str, weights: dict[str, float], other: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in weights.items()) + f" ELSE {other}::double END"


_R = releases.R
_SCORE = f"""({_weight('resolution', _R.RESOLUTION_WEIGHT, _R.OTHER_RESOLUTION)}) * (CASE WHEN seeders > 0 THEN log2(seeders::double + 1) / 10 ELSE 0.3::double END)
  * ({_weight('source_type', _R.SOURCE_WEIGHT, _R.OTHER_SOURCE)}) * ({_weight('audio', _R.AUDIO_FACTOR, _R.OTHER_AUDIO)}) * (CASE WHEN size_bytes > 80000000000 THEN 0.5::double WHEN size_bytes > 40000000000 THEN 0.7::double ELSE 1.0::double END)"""

_FEATURES = rf"""
t AS (
  SELECT *, list_filter(list_transform(list_filter(string_split(title, chr(10)), lambda x: contains(x, '💾')),
      lambda x: regexp_extract(regexp_replace(regexp_replace(x, '^[^💾]*💾', ''), '^\s+', ''), '^([^ ]*)(?: ([^ ]*))?', ['n', 'u'])), lambda p: try_cast(p.n AS double) IS NOT NULL AND p.u <> '')[1] AS size_part,
    list_filter(list_concat(list_transform(string_split(lower(binge_group), '|'), lambda x: trim(x)), string_split_regex(lower(binge_group), '\s+')), lambda x: x IN ('4k', '2160p', '1440p', '1080p', '720p', '480p'))[1] AS r1,
    list_filter(list_concat(list_transform(string_split(lower(name), '|'), lambda x: trim(x)), string_split_regex(lower(name), '\s+')), lambda x: x IN ('4k', '2160p', '1440p', '1080p', '720p', '480p'))[1] AS r2,
    try_cast(nullif(regexp_extract(title, '👤[^\S\n]*([0-9]*)', 1), '') AS bigint) AS s,
    lower(coalesce(binge_group, '') || '|' || coalesce(filename, '')) AS bf, lower(coalesce(filename, '') || ' ' || coalesce(title, '')) AS ft, lower(coalesce(binge_group, '') || '|' || coalesce(title, '')) AS bt
  FROM {{listings}}
), f0 AS (
  SELECT source_idx, pos, info_hash, file_idx, split_part(regexp_replace(regexp_replace(source_url, '^https://', ''), '^http://', ''), '.', 1) AS source,
    CASE WHEN s <= 4294967295 THEN s END AS seeders,
    floor(try_cast(size_part.n AS double) * CASE upper(size_part.u) WHEN 'TB' THEN 1099511627776::double WHEN 'GB' THEN 1073741824::double WHEN 'MB' THEN 1048576::double WHEN 'KB' THEN 1024::double END)::bigint AS size_bytes,
    size_part.n || ' ' || size_part.u AS size_display,
    CASE WHEN coalesce(r1, r2) = '4k' THEN '2160p' ELSE coalesce(r1, r2) END AS resolution,
    {_case('bf', _R.CODECS)} AS codec, {_case('ft', _R.AUDIO)} AS audio, {_case('bt', _R.SOURCE_TYPES)} AS source_type,
    contains(bt, 'hdr') OR contains(bt, 'dolby vision') OR contains(bt, '|dv') AS hdr,
    contains(lower(coalesce(name, '')), 'imax') OR contains(lower(coalesce(title, '')), 'imax') OR contains(lower(coalesce(filename, '')), 'imax') AS imax
  FROM t
), f AS (SELECT *, {_SCORE} AS score FROM f0)
"""

_MERGED = rf"""
, g AS (
  SELECT info_hash, arg_min(struct_pack(seeders, score, file_idx, size_bytes, size_display, resolution, codec, audio, source_type, hdr, imax), (source_idx, pos)) AS a, max(seeders) AS seeders,
    list(DISTINCT struct_pack(i := source_idx, source)) AS names
  FROM f GROUP BY info_hash
), m0 AS (
  SELECT info_hash, list_reduce(list_transform(list_sort(names), lambda x: x.source), lambda acc, x: CASE WHEN contains(acc, x) THEN acc ELSE acc || CASE WHEN acc = '' THEN '' ELSE ', ' END || x END, '') AS sources,
    seeders, a.seeders AS own, a.score AS own_score, a.file_idx, a.size_bytes, a.size_display, a.resolution, a.codec, a.audio, a.source_type, a.hdr, a.imax
  FROM g
), m AS (SELECT * EXCLUDE (own, own_score), CASE WHEN coalesce(seeders > coalesce(own, -1), false) THEN {_SCORE} ELSE own_score END AS score FROM m0)
"""


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carrier(spark, sf_dir, "listings", deal="lineitem")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.merge_listings(_listings(spark, sf_dir))


@query("release_features", with_carriers(f"WITH {_FEATURES} SELECT * REPLACE (round(score, 6) AS score) FROM f"))
def release_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.features(_listings(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("release_merge", with_carriers(f"WITH {_FEATURES} {_MERGED} SELECT * REPLACE (round(score, 6) AS score) FROM m"))
def release_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    "release_topk",
    with_carriers(
        f"""WITH {_FEATURES} {_MERGED}, k AS (SELECT * REPLACE (round(score, 6) AS score), coalesce(resolution, 'Unknown') AS bucket FROM m),
        p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, info_hash)::int AS place FROM k),
        b AS (SELECT bucket AS b, dense_rank() OVER (ORDER BY score DESC, bucket)::int AS group_place FROM p WHERE place = 1)
        SELECT p.*, group_place FROM p JOIN b ON bucket = b WHERE place <= 5"""
    ),
)
def release_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.top_per_resolution(_merged(spark, sf_dir).withColumn("score", F.round("score", 6)))


@query(
    "release_estimate",
    with_carriers(
        f"""WITH {_FEATURES} {_MERGED}, k AS (SELECT * REPLACE (round(score, 6) AS score) FROM m WHERE resolution IS NOT NULL),
        e AS (SELECT resolution, count(*) AS n, arg_min(struct_pack(size_bytes, size_display), (-score, info_hash)) FILTER (WHERE size_bytes IS NOT NULL) AS sized, arg_max(coalesce(size_display, chr(0)), (-score, info_hash)) AS last_display FROM k GROUP BY resolution)
        SELECT resolution, n, sized.size_bytes AS size_bytes, coalesce(sized.size_display, nullif(last_display, chr(0))) AS size_display,
          CASE resolution WHEN '2160p' THEN 4 WHEN '4K' THEN 4 WHEN '1080p' THEN 3 WHEN '720p' THEN 2 WHEN '480p' THEN 1 ELSE 0 END AS place FROM e"""
    ),
)
def release_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.estimates(_merged(spark, sf_dir).withColumn("score", F.round("score", 6)))
