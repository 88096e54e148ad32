"""Catalogue ETL: hits, titles, artwork picks, nested look-ups (SC1-SC6, PF1-PF9, PF11, PF13, PF16, SO1, JN17, JN19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.functions import labels

TITLE_SCHEMA = (
    "id bigint, title string, name string, tagline string, runtime int, episode_run_time array<int>, imdb_id string, external_ids struct<imdb_id: string>, "
    "credits struct<cast: array<struct<id: bigint, name: string>>, crew: array<struct<id: bigint, name: string, job: string>>>, "
    "seasons array<struct<season_number: bigint, name: string, episode_count: bigint>>"
)
LISTING_SCHEMA = "streams array<struct<infoHash: string, fileIdx: int, name: string, title: string>>"
POSTER, BACKDROP_WIDTH, STILL_WIDTH = "/none.jpg", 1920, 1280
CAST, RESUME_GUARD = 20, 30
# States of a download after which the release may be asked for again.
RETRIABLE = ["failed", "cancelled"]


def listing_rows(documents: DataFrame, text: str, *keys: str) -> DataFrame:
    """SC1, SC2: listed streams with their place; rows without a hash go; a document that can't be read gives none."""
    parsed = documents.select(*keys, F.from_json(text, LISTING_SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    rows = parsed.select(*keys, F.posexplode("d.streams").alias("pos", "s")).where("s.infoHash IS NOT NULL")
    return rows.select(*keys, "pos", F.col("s.infoHash").alias("info_hash"), F.coalesce("s.fileIdx", F.lit(0)).alias("file_idx"), F.coalesce("s.name", F.lit("")).alias("name"), F.coalesce("s.title", F.lit("")).alias("title"))


def unreadable(documents: DataFrame, text: str) -> DataFrame:
    """SC2's quarantine: documents that aren't JSON objects with streams."""
    return documents.where(F.from_json(text, LISTING_SCHEMA)["streams"].isNull())


def hits(rows: DataFrame, list_type: Column) -> DataFrame:
    """SC4, PF1: one shape for hits of any list; any other type, or none, takes the list's; a list without one drops the row."""
    kind = F.when(F.col("media_type").isin("movie", "tv"), F.col("media_type")).otherwise(list_type)
    shaped = rows.select("list_idx", "pos", "id", kind.alias("media_type"), F.coalesce("title", "name", F.lit("")).alias("title"), F.coalesce("release_date", "first_air_date").alias("date"))
    return shaped.where("media_type IS NOT NULL")


def first_wins(rows: DataFrame) -> DataFrame:
    """SO1: the first list whole, with its own repeats (kept on purpose); later lists add what no earlier row has."""
    keys, order = ["media_type", "id"], F.struct("list_idx", "pos")
    later = rows.where("list_idx > 0").groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")
    first = rows.where("list_idx = 0")
    return first.unionByName(later.join(first.select(*keys), keys, "left_anti").select(*rows.columns))


def flatten_titles(documents: DataFrame, text: str, kind: str) -> DataFrame:
    """SC3, PF2-PF4: both variants in one schema, each by its own fields: a film's title, runtime and id are not a series'."""
    film = F.col("media_type") == "movie"
    d = documents.select(F.col(kind).alias("media_type"), F.from_json(text, TITLE_SCHEMA).alias("d")).select("media_type", "d.*")
    return d.select(
        "id",
        "media_type",
        F.coalesce(F.when(film, F.col("title")).otherwise(F.col("name")), F.lit("")).alias("title"),
        F.regexp_replace("tagline", r"\.+$", "").alias("tagline"),
        F.when(film, F.col("runtime")).otherwise(F.get("episode_run_time", F.lit(0))).alias("runtime"),
        F.when(film, F.col("imdb_id")).otherwise(F.col("external_ids.imdb_id")).alias("imdb_id"),
        F.transform(F.slice(F.coalesce("credits.cast", F.array()), 1, CAST), lambda p: p["name"]).alias("cast"),
        F.transform(F.filter("credits.crew", lambda p: p["job"] == "Director"), lambda p: p["name"]).alias("directors"),
        F.filter("seasons", lambda s: (s["season_number"] > 0) & (s["episode_count"] > 0)).alias("seasons"),
    )


def _pick(images: DataFrame, order: Column, where: Column | None = None) -> DataFrame:
    images = images if where is None else images.where(where)
    return images.groupBy("id").agg(F.min_by("file_path", order).alias("path"))


def posters(images: DataFrame) -> DataFrame:
    """PF5: English first, then language-less, then widest; one pre-aggregated pass."""
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang").isNull(), 1).otherwise(2)
    return _pick(images, F.struct(rank, -F.col("width"), "pos"))


def logos(images: DataFrame) -> DataFrame:
    """PF6: widest English, else widest."""
    return _pick(images, F.struct(F.when(F.col("lang") == "en", 0).otherwise(1), -F.col("width"), "pos"))


def with_fallback(titles: DataFrame, picks: DataFrame, fallback: str) -> DataFrame:
    return titles.join(picks, "id", "left").withColumn("path", F.coalesce("path", F.lit(fallback)))


def backdrops(images: DataFrame, seed: int) -> DataFrame:
    """PF7: wide pictures without language, one per path; most votes first, the tail by votes and a seeded draw."""
    wide = images.where((F.col("width") >= BACKDROP_WIDTH) & F.col("lang").isNull())
    once = wide.groupBy("id", "file_path").agg(F.min_by("votes", "pos").alias("votes"), F.min("pos").alias("pos"))
    best = Window.partitionBy("id").orderBy(F.desc("votes"), "pos")
    draw = F.pmod(F.xxhash64(F.lit(seed), "file_path"), F.lit(10000)) / 10000.0
    ranked = once.withColumn("head", F.row_number().over(best) == 1).withColumn("weight", F.col("votes") + 2 * draw)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("head"), F.desc("weight"), "pos"))
    return ranked.withColumn("place", place)


def stills(images: DataFrame) -> DataFrame:
    """PF8: wide stills without language, most votes first."""
    wide = images.where((F.col("width") >= STILL_WIDTH) & F.col("lang").isNull())
    return wide.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("votes"), "pos"))).select("id", "file_path", "votes", "place")


def with_fallbacks(ranked: DataFrame, titles: DataFrame, fallback: str) -> DataFrame:
    """PF7, PF8: titles (or episodes) without a picture of their own get ``fallback``, if they have one, at place 1."""
    lone = titles.join(ranked.select("id").distinct(), "id", "left_anti").where(F.col(fallback).isNotNull())
    lone = lone.select("id", F.col(fallback).alias("file_path"), F.lit(1).alias("place"))
    return ranked.select("id", "file_path", "place").unionByName(lone)


def season_episodes(seasons: DataFrame, images: DataFrame) -> DataFrame:
    """SC5: a season's episodes zipped by position with the image lists of as many requests.

    ``seasons`` has an array ``episodes``, ``images`` arrays of (place, paths); a request without an answer is
    an empty list.
    """
    each = seasons.select("id", "season", F.posexplode("episodes").alias("place", "episode"))
    found = each.join(images, ["id", "season", "place"], "left")
    return found.select("id", "season", "place", "episode", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def text_tracks(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """PF10: embedded text subtitles whose language is unknown or allowed, with names."""
    kept = tracks.where(labels.is_text_subtitle(F.col("media_type")) & (F.col("language").isNull() | F.col("language").isin(languages)))
    codec = F.upper("codec")
    return kept.withColumn("name", F.coalesce("title", F.concat("language", F.lit(" ("), codec, F.lit(")")), codec))


def chapter_titles(chapters: DataFrame) -> DataFrame:
    """PF10: chapters without a title are named by their number."""
    return chapters.withColumn("title", F.coalesce("title", F.concat(F.lit("Chapter "), (F.col("idx") + 1).cast("string"))))


def trailers(videos: DataFrame, seed: int) -> DataFrame:
    """PF9: trailers before teasers, in a seeded order."""
    rank = F.when(F.col("type") == "Trailer", 0).when(F.col("type") == "Teaser", 1)
    return videos.where((F.col("site") == "YouTube") & rank.isNotNull()).orderBy("id", rank, F.xxhash64(F.lit(seed), "key"))


def episode_names(requests: DataFrame, episodes: DataFrame) -> DataFrame:
    """JN17, SC5: names and stills of asked episodes; ``Episode n`` where there is none."""
    found = requests.join(episodes, ["id", "season", "episode"], "left")
    return found.withColumn("name", F.coalesce("name", F.concat(F.lit("Episode "), F.col("episode").cast("string"))))


def track_labels(jobs: DataFrame, tracks: DataFrame) -> DataFrame:
    """JN19: a job's track name with its language, else ``Track n``."""
    found = jobs.join(tracks, ["file_id", "audio_index"], "left")
    named = F.concat(F.col("name"), F.coalesce(F.concat(F.lit(" ("), F.col("language"), F.lit(")")), F.lit("")))
    return found.withColumn("label", F.coalesce(named, F.concat(F.lit("Track "), (F.col("audio_index") + 1).cast("string"))))


def title_positions(history: DataFrame) -> DataFrame:
    """PF16, DM6: the history's row of each title, its last admitted heartbeat; one of a series needs its season and episode.

    A later episode takes the place of an earlier one.  Other columns of the heartbeat come along.
    """
    series = F.col("media_type") != "movie"
    admitted = history.where((F.col("position") > 0) & (~series | (F.col("season").isNotNull() & F.col("episode").isNotNull())))
    fields = [c for c in history.columns if c != "media_id"]
    last = admitted.groupBy("media_id").agg(F.max_by(F.struct(*fields), F.struct("seen_at", "seq")).alias("r")).select("media_id", "r.*")
    return last.withColumns({c: F.when(F.col("media_type") != "movie", F.col(c)) for c in ("season", "episode")})


def resumable(history: DataFrame) -> DataFrame:
    """PF13: titles (of a series, the episode) that go on where they were, unless that is all but the end."""
    return title_positions(history).where((F.col("duration") > 0) & (F.col("position") < F.col("duration") - RESUME_GUARD))


def resumable_of_recent(history: DataFrame, most: int = 20) -> DataFrame:
    """PF13: looked up among the ``most`` newest rows of the history only."""
    newest = title_positions(history).orderBy(F.desc("seen_at"), F.desc("seq")).limit(most)
    return newest.where((F.col("duration") > 0) & (F.col("position") < F.col("duration") - RESUME_GUARD))


def detail_resume(history: DataFrame, most: int | None = 20) -> DataFrame:
    """PF14: rows whose file is known (``info_hash``, not empty), of all or among the ``most`` newest; no guard at the end."""
    rows = title_positions(history)
    newest = rows if most is None else rows.orderBy(F.desc("seen_at"), F.desc("seq")).limit(most)
    return newest.where("info_hash <> ''")


def download_choices(rows: DataFrame) -> DataFrame:
    """PF15: whether a download may be tried again, and whether it blocks a new one; neither where there is none."""
    return rows.withColumns({"retriable": F.coalesce(F.col("status").isin(RETRIABLE), F.lit(False)), "blocked": F.coalesce(~F.col("status").isin(RETRIABLE), F.lit(False))})


def latest_positions(history: DataFrame) -> DataFrame:
    """DM6: the last heartbeat of each title."""
    return history.where("position > 0").groupBy("media_id").agg(F.max_by(F.struct("seq", "position", "download_id"), F.struct("seen_at", "seq")).alias("r")).select("media_id", "r.*")
