"""Queries over catalogue documents, artwork, compatibility, pictures, labels and presence."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.functions import labels as B, releases as R
from reelframe.operators import catalogue as C, compat as K, images as I, presence as P
from reelframe.plans.registry import query
from reelframe.sources.carriers import carrier, given, with_carriers as sql

_SHAPED = """(SELECT list_idx, pos, id, CASE WHEN media_type IN ('movie', 'tv') THEN media_type ELSE CASE list_idx WHEN 1 THEN 'movie' WHEN 2 THEN 'tv' END END AS media_type,
  coalesce(title, name, '') AS title, coalesce(release_date, first_air_date) AS date FROM {search_hits})"""


def _hits(spark, sf_dir):
    """List 0 is mixed and has no type of its own, 1 has films, 2 has series."""
    return C.hits(carrier(spark, sf_dir, "search_hits"), F.when(F.col("list_idx") == 1, "movie").when(F.col("list_idx") == 2, "tv"))


@query("hit_normalise", sql(f"SELECT * FROM {_SHAPED} WHERE media_type IS NOT NULL"))
def hit_normalise(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(
    "search_union",
    sql(f"""WITH h AS (SELECT * FROM {_SHAPED} WHERE media_type IS NOT NULL), l AS (SELECT *, row_number() OVER (PARTITION BY media_type, id ORDER BY list_idx, pos) AS n FROM h WHERE list_idx > 0)
    SELECT * FROM h WHERE list_idx = 0 UNION ALL SELECT * EXCLUDE (n) FROM l WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.list_idx = 0 AND h.media_type = l.media_type AND h.id = l.id)"""),
)
def search_union(spark, sf_dir):
    return C.first_wins(_hits(spark, sf_dir))


def _listing_json(spark, sf_dir):
    part = given(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 9 == 0, "{oops").otherwise(
        F.concat(F.lit('{"streams":[{"infoHash":"a'), F.col("p_partkey").cast("string"), F.lit('","fileIdx":2,"name":"'), F.col("p_name"), F.lit('"},{"name":"no hash"},{"infoHash":"b'), F.col("p_size").cast("string"), F.lit('","title":"t"}]}'))
    )
    return part.select("p_partkey", text.alias("json"))


@query(
    "listing_scan",
    """SELECT p_partkey, 0 AS pos, 'a' || p_partkey AS info_hash, 2 AS file_idx, p_name AS name, '' AS title FROM part WHERE p_partkey % 9 <> 0
    UNION ALL SELECT p_partkey, 2, 'b' || p_size, 0, '', 't' FROM part WHERE p_partkey % 9 <> 0""",
)
def listing_scan(spark, sf_dir):
    return C.listing_rows(_listing_json(spark, sf_dir), "json", "p_partkey")


@query("listing_quarantine", "SELECT p_partkey, '{oops' AS json FROM part WHERE p_partkey % 9 = 0")
def listing_quarantine(spark, sf_dir):
    return C.unreadable(_listing_json(spark, sf_dir), "json")


def _title_json(spark, sf_dir):
    part = given(spark, sf_dir, "part")
    c = lambda x: F.col(x).cast("string") if isinstance(x, str) else F.lit(x)
    text = F.concat(
        F.lit('{"id":'), c("p_partkey"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(',"title":"'), c("p_name"), F.lit('","imdb_id":"im'), c("p_partkey"), F.lit('","runtime":'), c("p_size"))).otherwise(F.concat(F.lit(',"name":"'), c("p_name"), F.lit('","episode_run_time":['), c("p_size"), F.lit(",99]"))),
        F.lit(',"tagline":"'), c("p_brand"), F.lit('...","external_ids":{"imdb_id":"tt'), c("p_partkey"), F.lit('"},"unknown":1,"credits":{"cast":[{"id":1,"name":"A"},{"id":2,"name":"'), c("p_type"),
        F.lit('"}],"crew":[{"id":3,"name":"D","job":"Director"},{"id":4,"name":"W","job":"Writer"}]},"seasons":[{"season_number":0,"name":"S0","episode_count":3},{"season_number":1,"name":"S1","episode_count":'), c("p_size"), F.lit("}]}"),
    )
    return part.select(F.when(F.col("p_size") % 2 == 0, "movie").otherwise("tv").alias("kind"), text.alias("json"))


@query(
    "title_flatten",
    """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'movie' ELSE 'tv' END AS media_type, p_name AS title, p_brand AS tagline, p_size AS runtime, CASE WHEN p_size % 2 = 0 THEN 'im' ELSE 'tt' END || p_partkey AS imdb_id,
    'A,' || p_type AS "cast", 'D' AS directors, 1 AS n_seasons FROM part""",
)
def title_flatten(spark, sf_dir):
    found = C.flatten_titles(_title_json(spark, sf_dir), "json", "kind")
    return found.select("id", "media_type", "title", "tagline", "runtime", "imdb_id", F.array_join("cast", ",").alias("cast"), F.array_join("directors", ",").alias("directors"), F.size("seasons").alias("n_seasons"))


_PICK = lambda order, extra="": f"WITH r AS (SELECT id, file_path, row_number() OVER (PARTITION BY id ORDER BY {order}) AS n FROM {{images}} {extra}), p AS (SELECT id, file_path FROM r WHERE n = 1)"


@query("poster_pick", sql(_PICK("CASE WHEN lang = 'en' THEN 0 WHEN lang IS NULL THEN 1 ELSE 2 END, width DESC, pos") + " SELECT m.id, coalesce(file_path, '/none.jpg') AS path FROM {media_items} m LEFT JOIN p ON m.id = p.id"))
def poster_pick(spark, sf_dir):
    return C.with_fallback(carrier(spark, sf_dir, "media_items").select("id"), C.posters(carrier(spark, sf_dir, "images")), C.POSTER)


@query("logo_pick", sql(_PICK("CASE WHEN lang = 'en' THEN 0 ELSE 1 END, width DESC, pos") + " SELECT id, file_path AS path FROM p"))
def logo_pick(spark, sf_dir):
    return C.logos(carrier(spark, sf_dir, "images"))


@query(
    "backdrop_rank",
    sql("""WITH o AS (SELECT id, file_path, arg_min(votes, pos) AS votes, min(pos) AS pos FROM {images} WHERE width >= 1920 AND lang IS NULL GROUP BY id, file_path),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, pos) AS n, count(*) OVER (PARTITION BY id) AS size FROM o) SELECT id, file_path, votes, size FROM r WHERE n = 1"""),
)
def backdrop_rank(spark, sf_dir):
    """The head and how many follow; the tail's order is drawn by a hash that DuckDB lacks (see the tests)."""
    ranked = C.backdrops(carrier(spark, sf_dir, "images"), seed=1)
    return ranked.groupBy("id").agg(F.min_by(F.struct("file_path", "votes"), "place").alias("h"), F.count("*").alias("size")).select("id", "h.*", "size")


@query("stills", sql("SELECT id, file_path, votes, row_number() OVER (PARTITION BY id ORDER BY votes DESC, pos)::int AS place FROM {images} WHERE width >= 1280 AND lang IS NULL"))
def stills(spark, sf_dir):
    return C.stills(carrier(spark, sf_dir, "images"))


@query("trailers", "SELECT event_id, user_id AS id, CASE event_type WHEN 'view' THEN 'Trailer' ELSE 'Teaser' END AS type FROM events WHERE event_type IN ('view', 'click') AND event_id % 3 <> 0")
def trailers(spark, sf_dir):
    videos = given(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), F.when(F.col("event_type") == "view", "Trailer").when(F.col("event_type") == "click", "Teaser").otherwise("Clip").alias("type"), F.when(F.col("event_id") % 3 != 0, "YouTube").otherwise("Vimeo").alias("site"), F.col("event_id").cast("string").alias("key"))
    return C.trailers(videos, seed=1).select("event_id", "id", "type")


@query(
    "episode_lookup",
    """WITH e AS (SELECT c_nationkey AS id, c_custkey % 5 AS season, c_custkey % 7 AS episode, min(c_name) AS name FROM customer WHERE c_custkey % 3 <> 0 GROUP BY ALL),
    q AS (SELECT DISTINCT c_nationkey AS id, c_custkey % 5 AS season, c_custkey % 7 AS episode FROM customer) SELECT id, season, episode, coalesce(name, 'Episode ' || episode) AS name FROM q LEFT JOIN e USING (id, season, episode)""",
)
def episode_lookup(spark, sf_dir):
    keys = [F.col("c_nationkey").alias("id"), (F.col("c_custkey") % 5).alias("season"), (F.col("c_custkey") % 7).alias("episode")]
    customer = given(spark, sf_dir, "customer")
    episodes = customer.where("c_custkey % 3 <> 0").groupBy(*keys).agg(F.min("c_name").alias("name"))
    return C.episode_names(customer.select(*keys).distinct(), episodes)


@query(
    "track_labels",
    sql("""WITH t AS (SELECT file_id, 0 AS audio_index, audio_0 AS name, 'en' AS language FROM {media_files} WHERE audio_0 IS NOT NULL UNION ALL SELECT file_id, 1, audio_1, NULL FROM {media_files} WHERE audio_1 IS NOT NULL),
    j AS (SELECT file_id, unnest([0, 1]) AS audio_index FROM {media_files}) SELECT file_id, audio_index, coalesce(name || coalesce(' (' || language || ')', ''), 'Track ' || (audio_index + 1)) AS label FROM j LEFT JOIN t USING (file_id, audio_index)"""),
)
def track_labels(spark, sf_dir):
    files = carrier(spark, sf_dir, "media_files")
    tracks = files.where("audio_0 IS NOT NULL").select("file_id", F.lit(0).alias("audio_index"), F.col("audio_0").alias("name"), F.lit("en").alias("language"))
    tracks = tracks.union(files.where("audio_1 IS NOT NULL").select("file_id", F.lit(1), "audio_1", F.lit(None).cast("string")))
    return C.track_labels(files.select("file_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("audio_index")), tracks).select("file_id", "audio_index", "label")


@query("watch_latest", sql("SELECT media_id, r.seq AS seq, r.position AS position, r.download_id AS download_id FROM (SELECT media_id, arg_max(struct_pack(seq, position, download_id), (seen_at, seq)) AS r FROM {watch} WHERE position > 0 GROUP BY media_id)"))
def watch_latest(spark, sf_dir):
    return C.latest_positions(carrier(spark, sf_dir, "watch"))


_POSITIONS = "(SELECT media_id, r.media_type AS media_type, CASE WHEN r.media_type = 'tv' THEN r.season END AS season, CASE WHEN r.media_type = 'tv' THEN r.episode END AS episode, r.seq AS seq, r.position AS position, r.duration AS duration, r.seen_at AS seen_at FROM (SELECT media_id, arg_max(struct_pack(media_type, season, episode, seq, position, duration, seen_at), (seen_at, seq)) AS r FROM {watch_episodes} WHERE position > 0 AND (media_type = 'movie' OR season IS NOT NULL AND episode IS NOT NULL) GROUP BY media_id))"
_GUARD = "duration > 0 AND position < duration - 30"
_SHOWN = ["media_id", "media_type", "season", "episode", "seq", "position", "duration"]


@query("watch_latest_episodes", sql(f"SELECT {', '.join(_SHOWN)} FROM {_POSITIONS}"))
def watch_latest_episodes(spark, sf_dir):
    return C.title_positions(carrier(spark, sf_dir, "watch_episodes")).select(*_SHOWN)


@query("resume_pick_episodes", sql(f"SELECT {', '.join(_SHOWN)} FROM {_POSITIONS} WHERE {_GUARD}"))
def resume_pick_episodes(spark, sf_dir):
    return C.resumable(carrier(spark, sf_dir, "watch_episodes")).select(*_SHOWN)


@query("resume_recent", sql(f"SELECT {', '.join(_SHOWN)} FROM (SELECT * FROM {_POSITIONS} ORDER BY seen_at DESC, seq DESC LIMIT 20) WHERE {_GUARD}"))
def resume_recent(spark, sf_dir):
    """PF13: looked up among the 20 newest rows of the history."""
    return C.resumable_of_recent(carrier(spark, sf_dir, "watch_episodes")).select(*_SHOWN)


@query("resume_labels", sql("SELECT seq, greatest(0, ceil((duration - position) / 60))::bigint AS minutes_left, round(CASE WHEN duration > 0 THEN position / duration ELSE 0 END, 6)::double AS ratio, CASE WHEN duration > 0 THEN least(100, floor(position * 100 / duration + 0.5))::bigint END AS pct FROM {watch}"))
def resume_labels(spark, sf_dir):
    p, d = F.col("position"), F.col("duration")
    return carrier(spark, sf_dir, "watch").select("seq", B.minutes_left(p, d).alias("minutes_left"), F.round(B.ratio(p, d), 6).alias("ratio"), B.progress_pct(p, d).alias("pct"))


_CLIENTS_REQUESTS = "(SELECT c.*, r.* FROM {clients} c CROSS JOIN (VALUES (0, false, false, false), (1, false, true, true), (2, false, false, false)) AS r(audio_index, force_video, force_audio, sdr))"
_PLAN = f"""WITH x AS (SELECT f.*, q.*, coalesce(tracks[audio_index + 1], tracks[1]) AS audio FROM (SELECT *, list_filter([audio_0, audio_1, audio_2], lambda a: a IS NOT NULL) AS tracks FROM {{media_files}}) f CROSS JOIN {_CLIENTS_REQUESTS} q),
o AS (SELECT *, list_contains(string_split(lower(video_codecs), ','), lower(video_codec)) AND NOT (video_codec = 'h264' AND bit_depth > 8) AND coalesce(chroma = '4:2:0', true) AND NOT (hdr AND sdr) AND coalesce(height <= max_height, true) AND NOT force_video AS video_ok,
  (audio IS NULL OR list_contains(string_split(lower(audio_codecs), ','), lower(audio))) AND NOT force_audio AS audio_ok, list_contains(string_split(lower(containers), ','), lower(container)) AS container_ok FROM x),
d AS (SELECT *, video_ok AND audio_ok AND container_ok AND (audio_index = 0 OR len(tracks) <= 1) AS direct FROM o),
p AS (SELECT *, CASE WHEN direct THEN 'direct' WHEN video_ok AND video_codec IN ('h264', 'hevc', 'av1', 'vp9') THEN 'copy' ELSE 'transcode' END AS video_action,
  CASE WHEN audio IS NULL THEN 'none' WHEN direct THEN 'direct' WHEN audio_ok AND audio IN ('aac', 'ac3', 'eac3', 'opus', 'flac') THEN 'copy' ELSE 'transcode' END AS audio_action FROM d)"""


def _with_tracks(spark, sf_dir):
    tracks = F.filter(F.array("audio_0", "audio_1", "audio_2"), lambda a: a.isNotNull())
    return carrier(spark, sf_dir, "media_files").withColumn("audio_tracks", tracks)


def _planned(spark, sf_dir):
    requests = spark.createDataFrame([(0, False, False, False), (1, False, True, True), (2, False, False, False)], "audio_index int, force_video boolean, force_audio boolean, sdr boolean")
    return K.plan(_with_tracks(spark, sf_dir), carrier(spark, sf_dir, "clients"), requests)


@query("compat_matrix", sql(f"{_PLAN} SELECT file_id, client_id, audio_index, direct, video_action, audio_action FROM p"))
def compat_matrix(spark, sf_dir):
    return _planned(spark, sf_dir).select("file_id", "client_id", "audio_index", "direct", "video_action", "audio_action")


@query("playback_record", sql(f"{_PLAN} SELECT file_id, client_id, video_action || '+' || audio_action AS mode, hdr AND video_action <> 'transcode' AS hdr, CASE WHEN video_action <> 'transcode' THEN height WHEN height > least(max_height, 1441) THEN least(max_height, 1441) // 2 * 2 ELSE height END AS height FROM p"))
def playback_record(spark, sf_dir):
    """CP2 with an encoder that makes 1441 lines at most."""
    return K.playback_record(_planned(spark, sf_dir), 1441)


@query("universal_plan", sql("SELECT file_id, CASE WHEN video_codec IN ('h264', 'hevc', 'av1', 'vp9') THEN 'copy' ELSE 'transcode' END AS video_action, CASE WHEN a IS NULL THEN 'none' WHEN a = 'aac' THEN 'copy' ELSE 'transcode' END AS audio_action FROM (SELECT *, coalesce(audio_0, audio_1, audio_2) AS a FROM {media_files})"))
def universal_plan(spark, sf_dir):
    return K.universal_plan(_with_tracks(spark, sf_dir), only_audio=True).select("file_id", "video_action", "audio_action")


_HIST = "h AS (SELECT image_id, ((r >> 3) << 10) | ((g >> 3) << 5) | (b >> 3) AS key, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM {pixels} GROUP BY ALL)"
_SHADE = """c AS (SELECT image_id, key, n, r / n AS r, g / n AS g, b / n AS b FROM h),
  l AS (SELECT *, greatest(r, g, b) / 255 AS hi, least(r, g, b) / 255 AS lo FROM c),
  s AS (SELECT image_id, key, n, r, g, b, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(2 * ((hi + lo) / 2) - 1)) END AS saturation, (hi + lo) / 2 AS lightness FROM l)"""


@query("palette_hist", sql(f"WITH {_HIST}, {_SHADE} SELECT image_id, key, n, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(saturation, 6) AS saturation, round(lightness, 6) AS lightness FROM s"))
def palette_hist(spark, sf_dir):
    shades = I.shaded(I.histogram(carrier(spark, sf_dir, "pixels")))
    return shades.withColumns({c: F.round(c, 6) for c in ("r", "g", "b", "saturation", "lightness")})


@query("palette_dark", sql("SELECT image_id, " + ", ".join(f"floor(sum({c}) / count(*) * 0.35::double + 0.5)::bigint AS dark_{c}" for c in "rgb") + " FROM {pixels} WHERE r + g + b > 60 AND r + g + b < 600 GROUP BY image_id"))
def palette_dark(spark, sf_dir):
    return I.dark_mean(carrier(spark, sf_dir, "pixels"))


def _pick_sql() -> str:
    """IM3 in SQL: a table per target, in turn, of the best bucket that no earlier table holds."""
    parts = [f"{_HIST}", f"{_SHADE}", "m AS (SELECT *, max(n) OVER (PARTITION BY image_id) AS most FROM s)"]
    for k, (name, s0, s1, s2, l0, l1, l2) in enumerate(I.TARGETS):
        score = f"round(({I.SATURATION_WEIGHT}e0 * (1 - abs(saturation - {s1}e0)) + {I.LIGHTNESS_WEIGHT}e0 * (1 - abs(lightness - {l1}e0)) + {I.COUNT_WEIGHT}e0 * n / most) / 10, 9)"
        free = "".join(f" AND NOT EXISTS (FROM t{j} WHERE t{j}.image_id = m.image_id AND t{j}.key = m.key)" for j in range(k))
        parts.append(f"t{k} AS (SELECT image_id, '{name}' AS target, arg_min(key, (-{score}, key)) AS key FROM m WHERE saturation BETWEEN {s0}e0 AND {s2}e0 AND lightness BETWEEN {l0}e0 AND {l2}e0{free} GROUP BY image_id)")
    union = " UNION ALL ".join(f"FROM t{k}" for k in range(len(I.TARGETS)))
    return ", ".join(parts) + f", u AS ({union}), p AS (SELECT u.image_id, u.target, u.key, s.r, s.g, s.b FROM u JOIN s ON s.image_id = u.image_id AND s.key = u.key)"


@query("palette_pick", sql(f"WITH {_pick_sql()} SELECT * FROM p"))
def palette_pick(spark, sf_dir):
    return I.palette(I.shaded(I.histogram(carrier(spark, sf_dir, "pixels"))))


@query(
    "palette_accent",
    sql(f"""WITH {_pick_sql()}, picked AS (SELECT *, greatest(r, g, b) / 255 AS hi, least(r, g, b) / 255 AS lo FROM p), shade AS (SELECT *, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(2 * ((hi + lo) / 2) - 1)) END AS sat FROM picked),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY target = 'vibrant' DESC, round(sat, 9) DESC, key) AS place FROM shade)
    SELECT image_id, floor(r + 0.5)::bigint AS r, floor(g + 0.5)::bigint AS g, floor(b + 0.5)::bigint AS b FROM ranks WHERE place = 1"""),
)
def palette_accent(spark, sf_dir):
    return I.accents(I.palette(I.shaded(I.histogram(carrier(spark, sf_dir, "pixels")))))


@query(
    "palette_distinct",
    sql(f"""WITH RECURSIVE {_pick_sql()}, n AS (SELECT image_id, r, g, b, row_number() OVER (PARTITION BY image_id ORDER BY greatest(r, g, b) + least(r, g, b), r, g, b) AS k FROM p),
    w AS (SELECT image_id, k, r, g, b, 1 AS kept, true AS ok FROM n WHERE k = 1
      UNION ALL SELECT image_id, k, CASE WHEN ok THEN r ELSE last_r END, CASE WHEN ok THEN g ELSE last_g END, CASE WHEN ok THEN b ELSE last_b END, kept + ok::int, ok
      FROM (SELECT n.*, w.r AS last_r, w.g AS last_g, w.b AS last_b, w.kept, (n.r - w.r) ** 2 + (n.g - w.g) ** 2 + (n.b - w.b) ** 2 >= {I.NEAR} AND w.kept < {I.MOST} AS ok FROM w JOIN n ON n.image_id = w.image_id AND n.k = w.k + 1))
    SELECT image_id, kept - 1 AS place, r, g, b FROM w WHERE ok"""),
)
def palette_distinct(spark, sf_dir):
    return I.distinct_colours(I.palette(I.shaded(I.histogram(carrier(spark, sf_dir, "pixels")))))


@query(
    "letterbox",
    sql("""WITH f AS (SELECT image_id % 10 AS film, image_id AS frame, y, x, r AS luma FROM {pixels}), w AS (SELECT film, frame, y FROM f GROUP BY ALL HAVING floor(sum(luma) / count(*)) > 24),
    t AS (SELECT film, frame, min(y) AS top, max(y) AS bottom FROM w GROUP BY ALL), c AS (SELECT film, frame, top, bottom, x FROM f JOIN t USING (film, frame) WHERE y BETWEEN top AND bottom GROUP BY ALL HAVING floor(sum(luma) / count(*)) > 24),
    b AS (SELECT film, frame, bottom - top + 1 AS h, max(x) - min(x) + 1 AS w FROM c GROUP BY film, frame, top, bottom), m AS (SELECT film, max(row(h, w)) AS m FROM b GROUP BY film), z AS (SELECT b.film, b.h, max(b.w) AS w FROM b JOIN (SELECT film, max(h) AS h FROM b GROUP BY film) x ON b.film = x.film AND b.h = x.h GROUP BY ALL)
    SELECT film, w, h, round(w / h, 6) AS aspect FROM z"""),
)
def letterbox(spark, sf_dir):
    pixels = carrier(spark, sf_dir, "pixels").select((F.col("image_id") % 10).alias("film"), F.col("image_id").alias("frame"), "y", "x", F.col("r").alias("luma"))
    return I.letterbox(pixels)


@query(
    "peer_targets",
    sql("""WITH r AS (SELECT client_id, room, count(*) FILTER (WHERE mode <> 'remote') OVER w AS n_larger, last_value(CASE WHEN mode <> 'remote' THEN client_id END IGNORE NULLS) OVER w AS next_larger FROM {peers}
    WINDOW w AS (PARTITION BY room ORDER BY width DESC, client_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM r"""),
)
def peer_targets(spark, sf_dir):
    return P.peer_ranks(carrier(spark, sf_dir, "peers"))


@query("peer_pairs", sql("SELECT a.client_id, b.client_id AS peer_id FROM {peers} a JOIN {peers} b ON a.room = b.room AND b.mode <> 'remote' AND (b.width > a.width OR (b.width = a.width AND b.client_id > a.client_id))"))
def peer_pairs(spark, sf_dir):
    return P.larger_peers(carrier(spark, sf_dir, "peers"))


@query("pairing", sql("SELECT p.client_id, min(r.client_id) AS remote_id FROM {peers} p LEFT JOIN {peers} r ON r.paired_to = p.client_id AND r.mode = 'remote' WHERE p.mode <> 'remote' GROUP BY p.client_id"))
def pairing(spark, sf_dir):
    return P.pairing(carrier(spark, sf_dir, "peers"))


@query(
    "scalar_labels",
    sql("""WITH d AS (SELECT * FROM {downloads}) SELECT id,
      CASE WHEN total_bytes >= 1073741824 THEN printf('%.1f', total_bytes / 1073741824::double) || ' GB' WHEN total_bytes >= 1048576 THEN printf('%.0f', total_bytes / 1048576::double) || ' MB' WHEN total_bytes >= 1024 THEN printf('%.0f', total_bytes / 1024::double) || ' KB' ELSE total_bytes || ' B' END AS size,
      CASE WHEN id % 300 >= 60 THEN id % 300 // 60 || 'h ' || id % 300 % 60 || 'min' WHEN id % 300 > 0 THEN id % 300 || 'min' END AS runtime, left(created_at::varchar, 4) AS year,
      CASE WHEN id % 4 = 0 THEN 'Orphaned (' || left(info_hash, 12) || '…)' ELSE coalesce(CASE WHEN id % 5 <> 0 THEN name END, 'Untitled') || CASE WHEN file_idx > 0 AND id % 7 <> 0 THEN ' · S0' || file_idx || 'E' || CASE WHEN id % 20 + 1 < 10 THEN '0' || (id % 20 + 1) ELSE (id % 20 + 1)::varchar END ELSE '' END END AS entry,
      coalesce(CASE WHEN id % 5 = 0 THEN NULL ELSE name END, left(info_hash, 10) || '…') AS display, nullif(concat_ws(' · ', CASE WHEN id % 2 = 0 THEN status END, CASE WHEN id % 3 = 0 THEN name END), '') AS description,
      regexp_replace(regexp_replace(lower('--' || name || '!!x'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE file_idx WHEN 0 THEN 'eng' WHEN 1 THEN 'ger' ELSE 'xx' END AS language,
      CASE file_idx WHEN 0 THEN 'Mono' WHEN 1 THEN 'Stereo' END AS channels, CASE WHEN id % 2500 <= 576 THEN 5000 WHEN id % 2500 <= 720 THEN 9000 WHEN id % 2500 <= 1080 THEN 16000 WHEN id % 2500 <= 1440 THEN 25000 ELSE 40000 END AS bitrate,
      CASE status WHEN 'completed' THEN 'Downloaded' ELSE upper(left(status, 1)) || substr(status, 2) END AS status, 'pretranscoded/' || id || CASE WHEN id % 2 = 0 THEN '_audio_' ELSE '_full_' END || id % 3 || '.mp4' AS output, id AS parsed, replace(created_at::date::varchar, '-', '.') AS search_key,
      printf('%02d:%02d:%02d.%03d', id // 3600, id // 60 % 60, id % 60, 250) AS vtt, (id * 60 + 1.5)::double AS srt, CASE file_idx WHEN 0 THEN 'hevc' WHEN 1 THEN 'odd' ELSE CASE id % 2 WHEN 0 THEN 'mp2' ELSE 'mp3' END END AS codec, CASE file_idx WHEN 0 THEN 'mp4' ELSE 'video/x-odd' END AS container, CASE id % 3 WHEN 0 THEN 10 WHEN 1 THEN 12 END AS bit_depth, file_idx = 1 AS is_text FROM d"""),
)
def scalar_labels(spark, sf_dir):
    """FN1-FN20 over downloads."""
    c = F.col
    i, h, n = c("id"), c("info_hash"), c("name")
    output = B.output_name(i, i % 2 == 0, i % 3)
    rows = carrier(spark, sf_dir, "downloads")
    return rows.select(
        "id",
        B.human_bytes(c("total_bytes"), even=True).alias("size"),
        B.runtime_label(i % 300).alias("runtime"),
        B.release_year(c("created_at").cast("string")).alias("year"),
        B.entry_title(i % 4 == 0, h, F.when(i % 5 != 0, n), i % 7 != 0, c("file_idx"), i % 20 + 1).alias("entry"),
        B.display_title(F.when(i % 5 != 0, n), F.lit(""), h).alias("display"),
        B.description(F.when(i % 2 == 0, c("status")), F.when(i % 3 == 0, n)).alias("description"),
        B.slugify(F.concat(F.lit("--"), n, F.lit("!!x"))).alias("slug"),
        B.iso639(F.when(c("file_idx") == 0, "en").when(c("file_idx") == 1, "de").otherwise("xx"), B.LISTING_LANGUAGES).alias("language"),
        B.channel_label(c("file_idx") + 1).alias("channels"),
        B.bitrate_kbps(i % 2500).alias("bitrate"),
        B.status_label(c("status"), B.DOWNLOAD_LABELS).alias("status"),
        output.alias("output"),
        B.parsed_output(output)["download_id"].alias("parsed"),
        B.search_key(c("created_at").cast("date").cast("string")).alias("search_key"),
        B.vtt_time(i + 0.25).alias("vtt"),
        B.srt_seconds(F.concat(F.lit("0:"), i.cast("string"), F.lit(":01,500"))).alias("srt"),
        B.codec_name(F.when(c("file_idx") == 0, "video/x-h265").when(c("file_idx") == 1, "video/x-odd").otherwise("audio/mpeg"), F.lit(1), F.when(i % 2 != 0, 3)).alias("codec"),
        B.container_name(F.when(c("file_idx") == 0, "video/quicktime").otherwise("video/x-odd")).alias("container"),
        B.bit_depth(F.when(i % 3 == 0, "high-10").when(i % 3 == 1, "main-12").otherwise("main")).alias("bit_depth"),
        B.is_text_subtitle(F.when(c("file_idx") == 1, "application/x-ass").otherwise("subpicture/x-pgs")).alias("is_text"),
    )


@query(
    "airing_labels",
    """WITH o AS (SELECT o_orderkey AS id, epoch(o_orderdate::date::timestamp)::bigint - 883612800 + o_orderkey % 7 * 3600 + 60 * (o_orderkey % 3) AS d FROM orders)
    SELECT id, 'S' || (id % 9 + 1) || 'E' || id % 24 || ' ' || CASE WHEN d <= 0 THEN 'aired' WHEN d >= 86400 THEN 'in ' || d // 86400 || 'd ' || d % 86400 // 3600 || 'h' WHEN d >= 3600 THEN 'in ' || d // 3600 || 'h ' || d % 3600 // 60 || 'm' ELSE 'in ' || greatest(1, d // 60) || 'm' END AS label FROM o""",
)
def airing_labels(spark, sf_dir):
    """FN6 as of some hours before 1998-01-01."""
    as_of = F.lit(883612800).cast("bigint") - F.col("o_orderkey") % 7 * 3600 - F.col("o_orderkey") % 3 * 60
    return given(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), B.airing_label(F.date_format("o_orderdate", "yyyy-MM-dd"), as_of, F.col("o_orderkey") % 9 + 1, F.col("o_orderkey") % 24).alias("label"))


@query(
    "quality_split",
    """WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN md5(o_orderkey::varchar) || 'abcdEF01' ELSE md5(o_orderkey::varchar) END AS hash, CASE WHEN o_orderkey % 2 = 0 THEN 'AB-' || o_orderkey || '_xyz' ELSE 'k ' || o_orderkey END AS key, CASE o_orderkey % 3 WHEN 0 THEN 'Movie' WHEN 1 THEN 'tv' ELSE 'person' END AS kind FROM orders)
    SELECT id, regexp_matches(hash, '^[a-fA-F0-9]{40}$') AS hash_ok, regexp_matches(key, '^[A-Za-z0-9_-]{6,15}$') AS key_ok, CASE WHEN lower(kind) IN ('movie', 'tv') THEN lower(kind) END AS media_type FROM x""",
)
def quality_split(spark, sf_dir):
    """RF11, FN21: what goes to the quarantine."""
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string").cast("binary"))
    return given(spark, sf_dir, "orders").select(
        k.alias("id"),
        R.is_content_hash(F.when(k % 3 == 0, F.concat(digest, F.lit("abcdEF01"))).otherwise(digest)).alias("hash_ok"),
        R.is_video_key(F.when(k % 2 == 0, F.concat(F.lit("AB-"), k.cast("string"), F.lit("_xyz"))).otherwise(F.concat(F.lit("k "), k.cast("string")))).alias("key_ok"),
        B.media_type(F.when(k % 3 == 0, "Movie").when(k % 3 == 1, "tv").otherwise("person")).alias("media_type"),
    )
