"""Queries of ordered listings, nested payloads, choices, offsets and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.functions import labels as B
from reelframe.operators import catalogue as C, library as L, mutations as M, releases as Q, storage as S, subtitles as O, timeline as T
from reelframe.plans import library as PL, releases as PR, subtitles as PS, timeline as PT, titles as PN
from reelframe.plans.registry import oracle_of, query
from reelframe.sources.carriers import carrier, given, with_carriers as sql


@query("release_ranked", oracle_of("release_merge"))
def release_ranked(spark, sf_dir):
    """WN5: merged releases, the best first."""
    return Q.ranked(PR.release_merge(spark, sf_dir))


_DEFINITIONS = "SELECT 'c' || c_custkey AS slug, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS position, c_custkey AS created_at FROM customer"


@query("collection_definitions", _DEFINITIONS)
def collection_definitions(spark, sf_dir):
    key = F.col("c_custkey")
    return L.definitions(given(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key.cast("string")).alias("slug"), F.when(key % 5 != 0, F.col("c_nationkey")).alias("position"), key.alias("created_at")))


@query("downloads_newest", sql("SELECT id, status, created_at FROM {downloads}"))
def downloads_newest(spark, sf_dir):
    return L.newest_first(carrier(spark, sf_dir, "downloads").select("id", "status", "created_at"))


@query("jobs_newest", sql("SELECT id, status, created_at FROM {jobs}"))
def jobs_newest(spark, sf_dir):
    return L.newest_first(carrier(spark, sf_dir, "jobs").select("id", "status", "created_at"))


@query("release_state", sql("SELECT info_hash, file_idx, media_id, d.id AS state_id, d.status AS state_status FROM {download_meta} m LEFT JOIN (SELECT info_hash, file_idx, max(id) AS id, arg_max(status, id) AS status FROM {downloads} WHERE status <> 'failed' GROUP BY ALL) d USING (info_hash, file_idx)"))
def release_state(spark, sf_dir):
    """JN5: listed files with what is known of their downloads."""
    rows = carrier(spark, sf_dir, "download_meta").select(*L.FILE, "media_id")
    found = L.with_state(rows, carrier(spark, sf_dir, "downloads").where("status <> 'failed'"), L.FILE)
    return found.select(*L.FILE, "media_id", F.col("state.id").alias("state_id"), F.col("state.status").alias("state_status"))


@query("library_nested", sql("SELECT d.id, info_hash, d.status, media_id IS NOT NULL AS has_meta, media_id, title, season FROM {downloads} d LEFT JOIN {download_meta} USING (info_hash, file_idx) LEFT JOIN {media_items} m ON media_id = m.id"))
def library_nested(spark, sf_dir):
    """JN3: metadata as a struct that is null where there is none."""
    found = L.with_media(*[carrier(spark, sf_dir, c) for c in ("downloads", "download_meta", "media_items")])
    found = L.nested(found, "meta", F.col("meta_exists"), "media_id", "title", "season")
    return found.select("id", "info_hash", "status", F.col("meta").isNotNull().alias("has_meta"), "meta.*")


@query("jobs_nested", sql("SELECT j.id, download_id, media_id IS NOT NULL AS has_meta, media_id, title, episode FROM {jobs} j JOIN {downloads} d ON download_id = d.id LEFT JOIN {download_meta} USING (info_hash, file_idx) LEFT JOIN {media_items} m ON media_id = m.id"))
def jobs_nested(spark, sf_dir):
    """JN4: the same for jobs."""
    found = L.jobs_with_media(*[carrier(spark, sf_dir, c) for c in ("jobs", "downloads", "download_meta", "media_items")])
    return L.nested(found, "meta", F.col("meta_exists"), "media_id", "title", "episode").select("id", "download_id", F.col("meta").isNotNull().alias("has_meta"), "meta.*")


_TYPED = "(SELECT d.*, media_type FROM {{downloads}} d LEFT JOIN {{download_meta}} USING (info_hash, file_idx) LEFT JOIN {{media_items}} m ON media_id = m.id)"


@query(
    "library_categories",
    PL.sql(f"""WITH d AS {_TYPED.replace("{{", "{").replace("}}", "}")}, u AS (SELECT 'download' AS kind, media_type, d.id::varchar AS key, b.bytes FROM d JOIN {PL._DISK} b ON b.id = d.id
    UNION ALL SELECT 'job', d.media_type, j.id::varchar, j.bytes FROM {PL._JOB_DISK} j JOIN d ON j.download_id = d.id UNION ALL SELECT 'orphan', NULL, hash, bytes FROM {PL._ORPHANS})
    SELECT category, kind, key, bytes FROM u, (SELECT unnest(['all', 'movies', 'tv', 'pretranscoding', 'orphan']) AS category)
    WHERE CASE category WHEN 'all' THEN true WHEN 'movies' THEN media_type = 'movie' WHEN 'tv' THEN media_type = 'tv' WHEN 'pretranscoding' THEN kind = 'job' ELSE kind = 'orphan' END"""),
)
def library_categories(spark, sf_dir):
    """PF12, SO2: what each category shows."""
    typed = L.with_media(*[carrier(spark, sf_dir, c) for c in ("downloads", "download_meta", "media_items")])
    jobs = L.jobs_with_media(*[carrier(spark, sf_dir, c) for c in ("jobs", "downloads", "download_meta", "media_items")])
    orphans = S.orphans(carrier(spark, sf_dir, "storage_files"), PL.some_downloads(spark, sf_dir))
    typed = S.with_disk_bytes(typed, carrier(spark, sf_dir, "storage_files"))
    payloads = L.library_payloads(typed, L.with_output_bytes(jobs, carrier(spark, sf_dir, "outputs")), orphans)
    key = F.coalesce(F.col("download.id").cast("string"), F.col("job.id").cast("string"), "orphan.hash").alias("key")
    return L.by_category(payloads).select("category", "kind", key, "bytes")


@query(
    "shares_of_used",
    PL.sql(f"""WITH a AS (SELECT area, sum(length)::bigint AS bytes, 0 AS last FROM {PL._LOCATED} GROUP BY area), u AS (SELECT * FROM a UNION ALL SELECT 'other', greatest(0, 900000000000 - (SELECT coalesce(sum(bytes), 0) FROM a))::bigint, 1)
    SELECT area, bytes, round(bytes * 100.0::double / 1000000000000, 6) AS percent, round(coalesce(sum(bytes * 100.0::double / 1000000000000) OVER (ORDER BY last, area ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset" FROM u"""),
)
def shares_of_used(spark, sf_dir):
    return S.shares_of_used(carrier(spark, sf_dir, "storage_files"), 10**12, 9 * 10**11)


@query("active_counts_live", sql("SELECT active_downloads, active_jobs + live_sessions AS active_jobs, live_sessions FROM (SELECT (SELECT count(*) FROM {downloads} WHERE status IN ('queued', 'downloading')) AS active_downloads, (SELECT count(*) FROM {jobs} WHERE status IN ('queued', 'transcoding')) AS active_jobs, (SELECT count(*) FROM events WHERE event_type = 'view') AS live_sessions)"))
def active_counts_live(spark, sf_dir):
    """AG6 with live sessions: views that have no end yet."""
    sessions = given(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("ts")).alias("ended"))
    return L.active_counts(carrier(spark, sf_dir, "downloads"), carrier(spark, sf_dir, "jobs"), sessions)


_COLLECTIONS = "(SELECT c_custkey AS id, c_name AS name, true AS visible, c_nationkey < 5 AS system FROM customer)"


@query("collection_updates", f"SELECT id, CASE WHEN id % 3 = 0 THEN name || '!' ELSE name END AS name, CASE WHEN id % 2 = 0 THEN false ELSE visible END AS visible, system FROM {_COLLECTIONS}")
def collection_updates(spark, sf_dir):
    """DM11: new names and visibility, of system collections too."""
    rows = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(True).alias("visible"), (F.col("c_nationkey") < 5).alias("system"))
    asked = rows.select("id", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("!"))).alias("name"), F.when(F.col("id") % 2 == 0, F.lit(False)).alias("visible"))
    return M.collection_updates(rows, asked, "id")


def _detail(spark, sf_dir, most):
    named = F.when(F.col("seq") % 3 != 0, F.concat(F.lit("h"), F.col("seq").cast("string"))).otherwise(F.when(F.col("seq") % 2 == 0, ""))
    return C.detail_resume(carrier(spark, sf_dir, "watch_episodes").withColumn("info_hash", named), most).select("media_id", "seq", "position", "info_hash")


@query("resume_detail_hash", sql(f"SELECT media_id, seq, position, 'h' || seq AS info_hash FROM {PN._POSITIONS} WHERE seq % 3 <> 0"))
def resume_detail_hash(spark, sf_dir):
    """PF14: the row of each title whose file is known."""
    return _detail(spark, sf_dir, None)


@query("resume_detail_recent", sql(f"SELECT media_id, seq, position, 'h' || seq AS info_hash FROM (SELECT * FROM {PN._POSITIONS} ORDER BY seen_at DESC, seq DESC LIMIT 20) WHERE seq % 3 <> 0"))
def resume_detail_recent(spark, sf_dir):
    """PF14 as the page has it: looked up among the 20 newest rows of the history."""
    return _detail(spark, sf_dir, 20)


@query("download_choices", sql("SELECT id, status IN ('failed', 'cancelled') AS retriable, status NOT IN ('failed', 'cancelled') AS blocked FROM {downloads}"))
def download_choices(spark, sf_dir):
    return C.download_choices(carrier(spark, sf_dir, "downloads")).select("id", "retriable", "blocked")


@query("cue_at_offset", sql(f"SELECT p.track_id, p.t, min(idx) AS idx FROM {PS._POINTS} p LEFT JOIN {{cues}} c ON c.track_id = p.track_id AND p.t - 3 BETWEEN start_s AND end_s GROUP BY p.track_id, p.t"))
def cue_at_offset(spark, sf_dir):
    """JN11 with subtitles three seconds late."""
    return O.cue_at(carrier(spark, sf_dir, "cues"), PS.points(spark, sf_dir), 3)


@query(
    "cue_neighbours_offset",
    sql(f"""WITH a AS (SELECT *, lag(text) OVER (PARTITION BY track_id ORDER BY idx) AS previous, lead(text) OVER (PARTITION BY track_id ORDER BY idx) AS next FROM {{cues}}),
    c AS (SELECT p.track_id, p.t, coalesce(min(idx) FILTER (WHERE p.t - 3 BETWEEN start_s AND end_s), min(idx) FILTER (WHERE start_s > p.t)) AS found, coalesce(found, min(idx))::bigint AS idx FROM {PS._POINTS} p JOIN {{cues}} c ON c.track_id = p.track_id GROUP BY p.track_id, p.t)
    SELECT c.track_id, c.t, c.idx, CASE WHEN found IS NOT NULL THEN previous END AS previous, text AS current, CASE WHEN found IS NOT NULL THEN next END AS next FROM c JOIN a ON a.track_id = c.track_id AND a.idx = c.idx"""),
)
def cue_neighbours_offset(spark, sf_dir):
    """JN18 with the same offset: the next cue is still sought by the time itself."""
    return O.neighbours(carrier(spark, sf_dir, "cues"), PS.points(spark, sf_dir), 3)


@query(
    "season_episodes",
    """WITH s AS (SELECT c_nationkey AS id, c_custkey % 5 AS season, list(c_name ORDER BY c_custkey) AS episodes FROM customer GROUP BY ALL),
    e AS (SELECT id, season, (generate_subscripts(episodes, 1) - 1)::int AS place, unnest(episodes) AS episode FROM s), i AS (SELECT c_nationkey AS id, c_custkey % 5 AS season, (c_custkey % 7)::int AS place, list(DISTINCT c_mktsegment) AS paths FROM customer GROUP BY ALL)
    SELECT id, season, place, episode, coalesce(array_to_string(list_sort(paths), ','), '') AS paths FROM e LEFT JOIN i USING (id, season, place)""",
)
def season_episodes(spark, sf_dir):
    """SC5: episodes zipped by position with their pictures; none is an empty list."""
    customer = given(spark, sf_dir, "customer").withColumns({"id": F.col("c_nationkey"), "season": F.col("c_custkey") % 5})
    seasons = customer.groupBy("id", "season").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("episodes"))
    images = customer.groupBy("id", "season", (F.col("c_custkey") % 7).cast("int").alias("place")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("paths"))
    return C.season_episodes(seasons, images).withColumn("paths", F.array_join("paths", ","))


@query(
    "text_tracks",
    """WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'eng' WHEN 1 THEN NULL ELSE 'jpn' END AS language, CASE WHEN turn % 5 = 0 THEN role END AS title, CASE WHEN conv_id % 2 = 0 THEN 'ass' ELSE 'subrip' END AS codec FROM conversations WHERE conv_id % 7 <> 3)
    SELECT conv_id, turn, coalesce(title, language || ' (' || upper(codec) || ')', upper(codec)) AS name FROM t WHERE language IS NULL OR language IN ('eng', 'fre')""",
)
def text_tracks(spark, sf_dir):
    """PF10: text subtitles of unknown or allowed languages."""
    turn, conv = F.col("turn"), F.col("conv_id")
    kind = F.when(conv % 7 == 3, "subpicture/x-pgs").when(conv % 2 == 0, "application/x-ass").otherwise("text/x-raw")
    rows = given(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(turn % 3 == 0, "eng").when(turn % 3 == 2, "jpn").alias("language"), F.when(turn % 5 == 0, F.col("role")).alias("title"), kind.alias("media_type"), B.codec_name(kind, F.lit(None).cast("int"), F.lit(None).cast("int")).alias("codec"))
    return C.text_tracks(rows, ["eng", "fre"]).select("conv_id", "turn", "name")


@query("chapter_titles", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE 'Chapter ' || (turn + 1) END AS title FROM conversations")
def chapter_titles(spark, sf_dir):
    rows = given(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("idx"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("title"))
    return C.chapter_titles(rows).select("conv_id", "turn", "title")


@query(
    "job_labels",
    sql("""SELECT id, CASE WHEN total_ms * 1000 >= 1073741824 THEN printf('%.1f GB', total_ms * 1000 / 1073741824::double) ELSE printf('%.0f MB', total_ms * 1000 / 1048576::double) END AS size,
    CASE status WHEN 'completed' THEN 'Cached' ELSE upper(left(status, 1)) || substr(status, 2) END AS status, CASE audio_index WHEN 0 THEN 'nor' WHEN 1 THEN 'ukr' ELSE 'xx' END AS language,
    CASE WHEN only_audio THEN 'own title' ELSE trim('AAC ' || CASE audio_index WHEN 0 THEN 'Stereo' WHEN 1 THEN '' ELSE '5.1' END) END AS name FROM {jobs}"""),
)
def job_labels(spark, sf_dir):
    """FN1 of the server, FN11 for tracks, FN14's names, FN17 for jobs."""
    i = F.col("audio_index")
    code = F.when(i == 0, "nb").when(i == 1, "uk").otherwise("xx")
    channels = F.when(i == 0, 2).when(i == 1, 3).otherwise(6)
    name = B.track_name(F.when(F.col("only_audio"), "own title"), channels, F.lit("aac"))
    rows = carrier(spark, sf_dir, "jobs")
    return rows.select("id", B.server_bytes(F.col("total_ms") * 1000).alias("size"), B.status_label(F.col("status"), B.JOB_LABELS).alias("status"), B.iso639(code, B.TRACK_LANGUAGES).alias("language"), name.alias("name"))


@query(
    "sync_times",
    f"""WITH r AS (SELECT *, coalesce(sum(n * delta) OVER w, 0) AS base, coalesce(sum(n) OVER w, 0) AS first FROM {PT._RUNS} WINDOW w AS (PARTITION BY file_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT file_id, (first + k)::bigint AS sample, (base + k * delta)::bigint AS t FROM (SELECT *, unnest(range(n)) AS k FROM r))
    SELECT file_id, sample, t FROM x WHERE file_id % 2 = 1 OR sample % 5 = 0""",
)
def sync_times(spark, sf_dir):
    """TL4: samples of files with a sync table, and all samples of the others."""
    runs = given(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("run"), (1 + F.length("text") % 5).cast("bigint").alias("n"), (10 + F.col("turn")).alias("delta"))
    none = runs.select("file_id", F.lit(0).cast("bigint").alias("sample"), F.lit(0).cast("bigint").alias("shift")).where("false")
    samples = T.expand_runs(runs, none)
    return T.sync_times(samples, samples.where("file_id % 2 = 0 AND sample % 5 = 0").select("file_id", "sample"))
