"""Queries over library tables: joins, unions, queues, storage and batch merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelframe.operators import library as L, mutations as M, storage as S
from reelframe.plans.registry import query
from reelframe.sources.buckets import BucketedTable
from reelframe.sources.carriers import carrier, given, with_carriers
from reelframe.sources.workspace import shared_path, stored

MEMBERS = "SELECT 'r' || cast(n_regionkey AS varchar(20)) AS collection_slug, c_custkey % 2100 AS media_id, c_nationkey AS position, c_custkey AS added_at FROM customer JOIN nation ON c_nationkey = n_nationkey"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MEMBERS.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}"), customer=given(spark, sf_dir, "customer"), nation=given(spark, sf_dir, "nation"))


def sql(text: str) -> str:
    return with_carriers(text.replace("{members}", f"({MEMBERS})"))


@query("collection_items", sql("SELECT collection_slug, media_id, position, added_at, title FROM {members} JOIN {media_items} ON media_id = id"))
def collection_items(spark, sf_dir):
    return L.collection_items(members(spark, sf_dir), carrier(spark, sf_dir, "media_items"))


@query(
    "history_top20",
    sql("""SELECT seq, w.media_id, title, seen_at, position, info_hash, coalesce(file_idx, 0)::int AS file_idx FROM (SELECT w.*, title FROM {watch} w JOIN {media_items} m ON w.media_id = m.id ORDER BY seen_at DESC, seq DESC LIMIT 20) w LEFT JOIN {downloads} d ON w.download_id = d.id"""),
)
def history_top20(spark, sf_dir):
    return L.recent_history(carrier(spark, sf_dir, "watch"), carrier(spark, sf_dir, "media_items"), carrier(spark, sf_dir, "downloads"))


@query(
    "library_join",
    sql("SELECT d.id, info_hash, file_idx, status, media_id, season, episode, resolution, title, media_type, media_id IS NOT NULL AS meta_exists FROM {downloads} d LEFT JOIN {download_meta} USING (info_hash, file_idx) LEFT JOIN {media_items} m ON media_id = m.id"),
)
def library_join(spark, sf_dir):
    found = L.with_media(carrier(spark, sf_dir, "downloads"), carrier(spark, sf_dir, "download_meta"), carrier(spark, sf_dir, "media_items"))
    return found.select("id", "info_hash", "file_idx", "status", "media_id", "season", "episode", "resolution", "title", "media_type", "meta_exists")


@query(
    "jobs_join",
    sql("""SELECT j.id, download_id, audio_index, only_audio, j.status, info_hash, file_idx, media_id, title, media_id IS NOT NULL AS meta_exists
    FROM {jobs} j JOIN {downloads} d ON download_id = d.id LEFT JOIN {download_meta} USING (info_hash, file_idx) LEFT JOIN {media_items} m ON media_id = m.id"""),
)
def jobs_join(spark, sf_dir):
    found = L.jobs_with_media(*[carrier(spark, sf_dir, c) for c in ("jobs", "downloads", "download_meta", "media_items")])
    return found.select("id", "download_id", "audio_index", "only_audio", "status", "info_hash", "file_idx", "media_id", "title", "meta_exists")


@query("key_lookup", sql("SELECT d.id, info_hash, file_idx, status FROM {downloads} d WHERE (info_hash, file_idx) IN (SELECT (info_hash, file_idx) FROM {download_meta} WHERE resolution = '1080p')"))
def key_lookup(spark, sf_dir):
    keys = carrier(spark, sf_dir, "download_meta").where("resolution = '1080p'")
    return L.for_keys(carrier(spark, sf_dir, "downloads"), keys, L.FILE).select("id", "info_hash", "file_idx", "status")


_ASKED = "(SELECT 'r' || (c_custkey % 5) AS collection_slug, CASE WHEN c_custkey % 3 = 0 THEN 'tv' ELSE 'movie' END AS media_type, c_custkey % 2100 + 1000 AS tmdb_id, c_custkey AS place FROM customer)"


def _asked(spark, sf_dir):
    """Titles by type and number, asked for in collections; for some there is no such title."""
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 0, "tv").otherwise("movie")
    return given(spark, sf_dir, "customer").select(F.concat(F.lit("r"), k % 5).alias("collection_slug"), kind.alias("media_type"), (k % 2100 + 1000).alias("tmdb_id"), k.alias("place"))


@query("exists_member", sql(f"SELECT a.*, EXISTS (SELECT 1 FROM {{members}} c JOIN {{media_items}} m ON m.id = c.media_id WHERE c.collection_slug = a.collection_slug AND m.media_type = a.media_type AND m.tmdb_id = a.tmdb_id) AS held FROM {_ASKED} a"))
def exists_member(spark, sf_dir):
    return L.membership(_asked(spark, sf_dir), members(spark, sf_dir), carrier(spark, sf_dir, "media_items"))


@query(
    "cached_variant",
    sql("""WITH r AS (SELECT j.*, o.path, info_hash, file_idx, row_number() OVER (PARTITION BY info_hash, file_idx, audio_index ORDER BY only_audio, j.id) AS n FROM {jobs} j JOIN {downloads} d ON d.id = j.download_id
      JOIN {outputs} o ON o.path = 'pretranscoded/' || download_id || CASE WHEN only_audio THEN '_audio_' ELSE '_full_' END || audio_index || '.mp4' WHERE j.status = 'completed')
    SELECT info_hash, file_idx, audio_index, id, only_audio, path FROM r WHERE n = 1"""),
)
def cached_variant(spark, sf_dir):
    return L.cached_variant(*[carrier(spark, sf_dir, c) for c in ("jobs", "downloads", "outputs")])


@query(
    "vanished_outputs",
    sql("""WITH f AS (SELECT j.*, o.path IS NOT NULL AS there FROM {jobs} j LEFT JOIN {outputs} o ON o.path = 'pretranscoded/' || download_id || CASE WHEN only_audio THEN '_audio_' ELSE '_full_' END || audio_index || '.mp4' WHERE status = 'completed')
    SELECT id, download_id, 'failed' AS status FROM f WHERE NOT there AND NOT (only_audio AND EXISTS (SELECT 1 FROM f g WHERE g.download_id = f.download_id AND g.audio_index = f.audio_index AND g.there AND NOT g.only_audio))"""),
)
def vanished_outputs(spark, sf_dir):
    return L.vanished_outputs(carrier(spark, sf_dir, "jobs"), carrier(spark, sf_dir, "outputs"))


@query("resolve_keys", sql(f"SELECT a.*, (SELECT id FROM {{media_items}} m WHERE m.media_type = a.media_type AND m.tmdb_id = a.tmdb_id) AS media_id FROM {_ASKED} a"))
def resolve_keys(spark, sf_dir):
    """JN10: a scalar look-up as an equi join."""
    return L.resolved(_asked(spark, sf_dir), carrier(spark, sf_dir, "media_items"))


_LOCATED = "(SELECT regexp_extract(path, '^/data/([a-z]+)/([^/]+)/', 1) AS area, regexp_extract(path, '^/data/([a-z]+)/([^/]+)/', 2) AS name, lower(regexp_extract(path, '^/data/([a-z]+)/([^/]+)/', 2)) AS hash, path, length FROM {storage_files})"
_SIZED = f"(SELECT area, hash, sum(length)::bigint AS bytes, count(*) AS n_files FROM {_LOCATED} GROUP BY ALL)"
_SOME = "(SELECT * FROM {downloads} WHERE id % 5 <> 0)"
_ORPHANS = f"(SELECT name AS hash, sum(length)::bigint AS bytes FROM {_LOCATED} s WHERE area = 'downloads' AND NOT EXISTS (SELECT 1 FROM {_SOME} d WHERE lower(d.info_hash) = s.hash) GROUP BY name)"


def some_downloads(spark, sf_dir):
    """The carrier without every fifth download, so that storage holds orphans."""
    return carrier(spark, sf_dir, "downloads").where("id % 5 <> 0")


@query("dir_sizes", sql(f"SELECT * FROM {_SIZED}"))
def dir_sizes(spark, sf_dir):
    return S.dir_sizes(carrier(spark, sf_dir, "storage_files"))


@query("orphans", sql(f"SELECT * FROM {_ORPHANS}"))
def orphans(spark, sf_dir):
    return S.orphans(carrier(spark, sf_dir, "storage_files"), some_downloads(spark, sf_dir))


@query("missing_files", sql(f"SELECT id, info_hash FROM {{downloads}} d WHERE status = 'completed' AND NOT EXISTS (SELECT 1 FROM {_LOCATED} s WHERE area = 'downloads' AND s.hash = lower(d.info_hash))"))
def missing_files(spark, sf_dir):
    return S.missing_files(carrier(spark, sf_dir, "downloads"), carrier(spark, sf_dir, "storage_files")).select("id", "info_hash")


def _rollup_sql(distinct: str) -> str:
    return f"""WITH k AS (SELECT {distinct} lower(info_hash) AS hash, coalesce(media_type, 'untitled') AS media_type FROM {{downloads}} LEFT JOIN {{download_meta}} USING (info_hash, file_idx) LEFT JOIN {{media_items}} m ON media_id = m.id),
    t AS (SELECT area, coalesce(k.media_type, 'orphan') AS kind, bytes FROM {_SIZED} s LEFT JOIN k ON k.hash = s.hash WHERE area = 'downloads' UNION ALL SELECT area, '', bytes FROM {_SIZED} s WHERE area <> 'downloads')
    SELECT area, kind AS media_type, sum(bytes)::bigint AS bytes, grouping_id(area, kind)::bigint AS level FROM t GROUP BY ROLLUP (area, kind)"""


@query("storage_rollup", sql(_rollup_sql("")))
def storage_rollup(spark, sf_dir):
    return S.rollup(*[carrier(spark, sf_dir, c) for c in ("storage_files", "downloads", "download_meta", "media_items")])


@query("storage_rollup_distinct", sql(_rollup_sql("DISTINCT")))
def storage_rollup_distinct(spark, sf_dir):
    return S.rollup(*[carrier(spark, sf_dir, c) for c in ("storage_files", "downloads", "download_meta", "media_items")], distinct=True)


@query(
    "shares",
    sql(f"""WITH a AS (SELECT area, sum(length)::bigint AS bytes FROM {_LOCATED} GROUP BY area)
    SELECT area, bytes, round(bytes * 100.0::double / 1000000000000, 6) AS percent, round(coalesce(sum(bytes * 100.0::double / 1000000000000) OVER (ORDER BY area ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS "offset" FROM a"""),
)
def shares(spark, sf_dir):
    return S.shares(carrier(spark, sf_dir, "storage_files"), 10**12)


_DISK = f"(SELECT d.id, coalesce(b.bytes, 0)::bigint AS bytes FROM {{downloads}} d LEFT JOIN (SELECT hash, sum(length) AS bytes FROM {_LOCATED} WHERE area = 'downloads' GROUP BY hash) b ON b.hash = lower(d.info_hash))"
_JOB_DISK = "(SELECT j.*, coalesce(o.length, 0)::bigint AS bytes FROM {jobs} j LEFT JOIN {outputs} o ON o.path = 'pretranscoded/' || download_id || CASE WHEN only_audio THEN '_audio_' ELSE '_full_' END || audio_index || '.mp4')"


@query(
    "library_union",
    sql(f"""SELECT 'download' AS kind, d.id::varchar AS key, b.bytes AS bytes, status, NULL::bigint AS total_ms FROM {{downloads}} d JOIN {_DISK} b ON b.id = d.id UNION ALL
    SELECT 'job', id::varchar, bytes, status, total_ms FROM {_JOB_DISK} UNION ALL SELECT 'orphan', hash, bytes, NULL, NULL FROM {_ORPHANS}"""),
)
def library_union(spark, sf_dir):
    files, d = carrier(spark, sf_dir, "storage_files"), some_downloads(spark, sf_dir)
    jobs = L.with_output_bytes(carrier(spark, sf_dir, "jobs"), carrier(spark, sf_dir, "outputs"))
    # Written before the sort, which reads its rows twice.
    return L.entries_of(stored(L.library_entries(S.with_disk_bytes(carrier(spark, sf_dir, "downloads"), files), jobs, S.orphans(files, d)), "entries"))


@query("active_counts", sql("SELECT (SELECT count(*) FROM {downloads} WHERE status IN ('queued', 'downloading')) AS active_downloads, (SELECT count(*) FROM {jobs} WHERE status IN ('queued', 'transcoding')) AS active_jobs"))
def active_counts(spark, sf_dir):
    return L.active_counts(carrier(spark, sf_dir, "downloads"), carrier(spark, sf_dir, "jobs"))


@query(
    "jobs_by_download",
    sql("""SELECT download_id, d.status, array_to_string(list(j.id::varchar || ':' || j.status ORDER BY j.id), ',') AS jobs, bool_or(j.status = 'completed') AS any_complete
    FROM {jobs} j JOIN {downloads} d ON download_id = d.id GROUP BY download_id, d.status"""),
)
def jobs_by_download(spark, sf_dir):
    found = L.jobs_by_download(carrier(spark, sf_dir, "downloads"), carrier(spark, sf_dir, "jobs"))
    return found.withColumn("jobs", F.array_join(F.transform("jobs", lambda j: F.concat(j["id"].cast("string"), F.lit(":"), j["status"])), ","))


@query("queue_head", sql("SELECT id, created_at FROM {downloads} WHERE status = 'queued' ORDER BY created_at, id LIMIT 3"))
def queue_head(spark, sf_dir):
    return L.queue_head(carrier(spark, sf_dir, "downloads"), 3).select("id", "created_at")


@query(
    "queue_heads",
    sql("WITH r AS (SELECT id, audio_index, row_number() OVER (PARTITION BY audio_index ORDER BY created_at, id)::int AS place FROM {jobs} WHERE status = 'queued') SELECT * FROM r WHERE place <= 2"),
)
def queue_heads(spark, sf_dir):
    return L.queue_head(carrier(spark, sf_dir, "jobs"), 2, ["audio_index"]).select("id", "audio_index", "place")


@query("queue_evict", sql("SELECT status, arg_min(id, (created_at, id)) AS id FROM {downloads} WHERE file_idx < 2 GROUP BY status"))
def queue_evict(spark, sf_dir):
    return L.oldest_below(carrier(spark, sf_dir, "downloads"), F.col("file_idx"), 2)


@query(
    "renumber",
    sql("""WITH c AS (SELECT DISTINCT collection_slug, media_id FROM {members}), b AS (SELECT collection_slug, media_id, min(position)::bigint AS position FROM {members} GROUP BY ALL),
    n AS (SELECT collection_slug, media_id, row_number() OVER (PARTITION BY collection_slug ORDER BY media_id DESC) - 1 AS p FROM c WHERE media_id % 3 <> 0)
    SELECT collection_slug, media_id, coalesce(n.p, b.position) AS position FROM b LEFT JOIN n USING (collection_slug, media_id)"""),
)
def renumber(spark, sf_dir):
    base = members(spark, sf_dir).groupBy("collection_slug", "media_id").agg(F.min("position").cast("bigint").alias("position"))
    order = base.where("media_id % 3 <> 0").select("collection_slug", "media_id", (-F.col("media_id")).alias("place"))
    return L.renumbered(base, order)


_BASE = "(SELECT id, info_hash, file_idx, total_bytes, status, created_at FROM {downloads} WHERE id % 3 <> 0)"
_NEW = "(SELECT id, info_hash, file_idx, total_bytes + 1 AS total_bytes, 'queued' AS status, created_at FROM {downloads} WHERE id % 2 = 0 OR id % 3 = 0)"


def _base(spark, sf_dir):
    return carrier(spark, sf_dir, "downloads").where("id % 3 <> 0").select("id", "info_hash", "file_idx", "total_bytes", "status", "created_at")


def _new(spark, sf_dir):
    rows = carrier(spark, sf_dir, "downloads").where("id % 2 = 0 OR id % 3 = 0")
    return rows.select("id", "info_hash", "file_idx", (F.col("total_bytes") + 1).alias("total_bytes"), F.lit("queued").alias("status"), "created_at")


@query("upsert_overwrite", sql(f"SELECT * FROM {_NEW} UNION ALL SELECT * FROM {_BASE} b WHERE b.id % 2 <> 0"))
def upsert_overwrite(spark, sf_dir):
    return M.upsert(_base(spark, sf_dir), _new(spark, sf_dir), ["info_hash", "file_idx"], "created_at")


@query("upsert_bucketed", sql(f"SELECT * FROM {_NEW} WHERE id % 5 = 0 UNION ALL SELECT * FROM {_BASE} b WHERE b.id % 2 <> 0 OR b.id % 5 <> 0"))
def upsert_bucketed(spark, sf_dir):
    """DM1, DM3 on a stored table in buckets, of which only those that change are written anew."""
    table = BucketedTable(spark, shared_path(spark, "bucketed"), ["info_hash", "file_idx"], 32)
    table.create(_base(spark, sf_dir))
    table.merge(_new(spark, sf_dir).where("id % 5 = 0"), "created_at")
    return table.read()


@query("insert_absent", sql(f"SELECT * FROM {_BASE} UNION ALL SELECT * FROM {_NEW} n WHERE n.id % 3 = 0"))
def insert_absent(spark, sf_dir):
    return M.insert_absent(_base(spark, sf_dir), _new(spark, sf_dir), ["info_hash", "file_idx"])


@query(
    "insert_with_ids",
    sql(f"SELECT * FROM {_BASE} UNION ALL SELECT (SELECT max(id) FROM {_BASE}) + row_number() OVER (ORDER BY created_at, info_hash, file_idx), info_hash, file_idx, total_bytes, status, created_at FROM {_NEW} n WHERE n.id % 3 = 0"),
)
def insert_with_ids(spark, sf_dir):
    return M.insert_with_ids(_base(spark, sf_dir), _new(spark, sf_dir), ["info_hash", "file_idx"], ["created_at", "info_hash", "file_idx"])


@query(
    "reset_upsert",
    sql("""WITH b AS (SELECT id, status, transcoded_ms FROM {jobs} WHERE id % 3 <> 0), n AS (SELECT id FROM {jobs} WHERE id % 2 = 0 OR id % 3 = 0)
    SELECT coalesce(b.id, n.id) AS id, CASE WHEN n.id IS NOT NULL AND (b.status IS NULL OR b.status NOT IN ('queued', 'transcoding', 'paused', 'completed')) THEN 'queued' ELSE b.status END AS status,
      CASE WHEN n.id IS NOT NULL AND (b.status IS NULL OR b.status NOT IN ('queued', 'transcoding', 'paused', 'completed')) THEN 0 ELSE transcoded_ms END AS transcoded_ms FROM b FULL JOIN n ON b.id = n.id"""),
)
def reset_upsert(spark, sf_dir):
    jobs = carrier(spark, sf_dir, "jobs")
    return M.reset_upsert(jobs.where("id % 3 <> 0").select("id", "status", "transcoded_ms"), jobs.where("id % 2 = 0 OR id % 3 = 0"), "id", ["queued", "transcoding", "paused", "completed"], {"status": F.lit("queued"), "transcoded_ms": F.lit(0).cast("bigint")})


@query("delete_cascade", sql("SELECT id, download_id FROM {jobs} WHERE download_id NOT IN (SELECT id FROM {downloads} WHERE status = 'failed')"))
def delete_cascade(spark, sf_dir):
    gone = carrier(spark, sf_dir, "downloads").where("status = 'failed'")
    return M.delete_cascade(gone, carrier(spark, sf_dir, "jobs"), "id", "download_id").select("id", "download_id")


@query("delete_set_null", sql("SELECT seq, CASE WHEN download_id NOT IN (SELECT id FROM {downloads} WHERE status = 'failed') THEN download_id END AS download_id FROM {watch}"))
def delete_set_null(spark, sf_dir):
    gone = carrier(spark, sf_dir, "downloads").where("status = 'failed'")
    return M.delete_set_null(gone, carrier(spark, sf_dir, "watch").select("seq", "download_id"), "id", "download_id")


_ACTION = "CASE id % 9 WHEN 0 THEN 'pause' WHEN 1 THEN 'queue' WHEN 2 THEN 'cancel' WHEN 3 THEN 'fail' WHEN 4 THEN 'complete' WHEN 5 THEN 'claim' WHEN 6 THEN 'stop' WHEN 7 THEN 'abort' END"


def _transition_sql(table: str, rules: str) -> str:
    return sql(f"WITH d AS (SELECT id, status, {_ACTION} AS action FROM {{{table}}}), n AS (SELECT *, CASE {rules} END AS next FROM d) SELECT id, coalesce(next, status) AS status, next IS NOT NULL AS applied FROM n")


@query(
    "transitions",
    _transition_sql("downloads", """WHEN action = 'pause' AND status NOT IN ('completed', 'failed') THEN 'paused' WHEN action = 'queue' AND status NOT IN ('completed', 'failed') THEN 'queued'
      WHEN action = 'cancel' AND status NOT IN ('completed', 'failed') THEN 'cancelled' WHEN action = 'fail' AND status NOT IN ('cancelled', 'paused') THEN 'failed' WHEN action = 'complete' THEN 'completed'"""),
)
def transitions(spark, sf_dir):
    rows = carrier(spark, sf_dir, "downloads").select("id", "status")
    return M.transitions(rows, rows.select("id", F.expr(_ACTION).alias("action")), M.DOWNLOAD_ACTIONS)


@query(
    "job_transitions",
    _transition_sql("one_jobs", """WHEN action = 'pause' AND status IN ('queued', 'transcoding') THEN 'paused' WHEN action = 'queue' AND status = 'paused' THEN 'queued' WHEN action = 'cancel' AND status NOT IN ('completed', 'failed') THEN 'cancelled'
      WHEN action = 'fail' AND status <> 'cancelled' THEN 'failed' WHEN action = 'complete' AND status = 'transcoding' THEN 'completed' WHEN action = 'claim' AND status = 'queued' THEN 'transcoding'
      WHEN action = 'stop' AND status = 'transcoding' THEN 'cancelled' WHEN action = 'abort' AND status NOT IN ('queued', 'cancelled', 'paused') THEN 'failed'"""),
)
def job_transitions(spark, sf_dir):
    rows = carrier(spark, sf_dir, "one_jobs")
    return M.transitions(rows, rows.select("id", F.expr(_ACTION).alias("action")), M.JOB_ACTIONS)


@query("boot_recovery", sql("SELECT id, CASE WHEN status = 'transcoding' THEN 'queued' ELSE status END AS status, CASE WHEN status IN ('transcoding', 'paused') THEN 0 ELSE transcoded_ms END::bigint AS transcoded_ms FROM {jobs}"))
def boot_recovery(spark, sf_dir):
    return M.recovered_jobs(carrier(spark, sf_dir, "jobs").select("id", "status", "transcoded_ms"), "transcoded_ms")


@query("boot_recovery_downloads", sql("SELECT id, CASE WHEN status = 'downloading' THEN 'queued' ELSE status END AS status, floor(grown)::bigint AS grown FROM {downloads}"))
def boot_recovery_downloads(spark, sf_dir):
    return M.recovered_downloads(carrier(spark, sf_dir, "downloads").select("id", "status", F.floor("grown").alias("grown")))


@query("restart_reset", sql("SELECT id, CASE WHEN status IN ('paused', 'cancelled', 'failed') THEN 'queued' ELSE status END AS status, floor(grown)::bigint AS grown, CASE WHEN status NOT IN ('paused', 'cancelled', 'failed') THEN 'error of ' || name END AS error FROM {downloads}"))
def restart_reset(spark, sf_dir):
    return M.restarted(carrier(spark, sf_dir, "downloads").select("id", "status", F.floor("grown").alias("grown"), F.concat(F.lit("error of "), "name").alias("error")))


@query("protected_delete", sql("SELECT id, title, false AS refused FROM {media_items} WHERE id % 4 <> 0 OR media_type = 'tv' UNION ALL SELECT id, title, true FROM {media_items} WHERE id % 4 = 0 AND media_type = 'tv'"))
def protected_delete(spark, sf_dir):
    titles = carrier(spark, sf_dir, "media_items").select("id", "title", "media_type")
    stays, refused = M.protected_delete(titles, titles.where("id % 4 = 0"), "id", F.col("media_type") == "tv")
    return stays.withColumn("refused", F.lit(False)).union(refused.withColumn("refused", F.lit(True))).drop("media_type")
