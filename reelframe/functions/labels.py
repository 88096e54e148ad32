"""Scalar labels and formats as Column expressions (FN1-FN21)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Language codes of two letters by three, for listings and for tracks (the two tables differ).
LISTING_LANGUAGES = {
    "en": "eng", "nl": "dut", "fr": "fre", "de": "ger", "es": "spa", "it": "ita", "pt": "por", "ru": "rus", "ja": "jpn", "ko": "kor",
    "zh": "chi", "ar": "ara", "pl": "pol", "tr": "tur", "sv": "swe", "no": "nor", "da": "dan", "fi": "fin", "cs": "cze", "ro": "rum",
    "hu": "hun", "el": "gre", "he": "heb", "th": "tha", "vi": "vie", "id": "ind",
}
TRACK_LANGUAGES = {
    "en": "eng", "nl": "dut", "de": "ger", "fr": "fre", "es": "spa", "it": "ita", "pt": "por", "ru": "rus", "ja": "jpn", "zh": "chi",
    "ko": "kor", "ar": "ara", "pl": "pol", "sv": "swe", "da": "dan", "no": "nor", "nb": "nor", "fi": "fin", "tr": "tur", "cs": "cze",
    "hu": "hun", "el": "gre", "he": "heb", "hi": "hin", "th": "tha", "ro": "rum", "uk": "ukr", "vi": "vie", "id": "ind", "ms": "may",
    "bg": "bul", "hr": "hrv", "sr": "srp", "sk": "slo", "sl": "slv", "et": "est", "lv": "lav", "lt": "lit", "fa": "per", "ca": "cat",
    "eu": "baq", "gl": "glg", "is": "ice",
}

# Bit rates in kbit/s up to a picture height, and above the last.
BIT_RATES = [(576, 5_000), (720, 9_000), (1080, 16_000), (1440, 25_000)]
HIGHEST_BIT_RATE = 40_000
# Status labels of downloads and of jobs.
DOWNLOAD_LABELS = {"queued": "Queued", "downloading": "Downloading", "paused": "Paused", "completed": "Downloaded", "failed": "Failed", "cancelled": "Cancelled"}
JOB_LABELS = {"queued": "Queued", "transcoding": "Transcoding", "paused": "Paused", "completed": "Cached", "failed": "Failed", "cancelled": "Cancelled"}
CHANNELS = {1: "Mono", 2: "Stereo", 6: "5.1", 8: "7.1"}
# Short names of codecs and containers by media type, and the types of plain-text subtitles.
CODEC_NAMES = {
    "video/x-h264": "h264",
    "video/x-h265": "hevc",
    "video/x-av1": "av1",
    "video/x-vp9": "vp9",
    "video/x-vp8": "vp8",
    "video/x-theora": "theora",
    "video/x-divx": "mpeg4",
    "video/x-xvid": "mpeg4",
    "video/x-wmv": "wmv",
    "audio/x-ac3": "ac3",
    "audio/x-eac3": "eac3",
    "audio/x-dts": "dts",
    "audio/x-true-hd": "truehd",
    "audio/x-opus": "opus",
    "audio/x-vorbis": "vorbis",
    "audio/x-flac": "flac",
    "audio/x-alac": "alac",
    "audio/x-wma": "wma",
    "audio/x-raw": "pcm",
    "text/x-raw": "subrip",
    "application/x-ssa": "ssa",
    "application/x-ass": "ass",
    "application/x-subtitle-vtt": "webvtt",
    "subpicture/x-pgs": "hdmv_pgs_subtitle",
    "subpicture/x-dvd": "dvd_subtitle",
    "subpicture/x-dvb": "dvb_subtitle",
}
CONTAINER_NAMES = {
    "video/x-matroska": "matroska",
    "video/webm": "webm",
    "video/quicktime": "mp4",
    "video/mp4": "mp4",
    "audio/x-m4a": "mp4",
    "video/mpegts": "mpegts",
    "video/x-msvideo": "avi",
    "video/mpeg": "mpeg",
    "video/x-flv": "flv",
    "application/ogg": "ogg",
}
TEXT_SUBTITLES = ["text/x-raw", "application/x-ssa", "application/x-ass", "application/x-subtitle-vtt"]


def human_bytes(n: Column, even: bool = False) -> Column:
    """Halves go up, or to the even digit as ``printf`` has them."""
    rounded = lambda x, places: F.bround(x, places) if even else x
    f = lambda unit, places: F.concat(F.format_string(f"%.{places}f", rounded(n / float(1024**unit), places)), F.lit(["", " KB", " MB", " GB", " TB"][unit]))
    return F.when(n >= 1024**4, f(4, 2)).when(n >= 1024**3, f(3, 1)).when(n >= 1024**2, f(2, 0)).when(n >= 1024, f(1, 0)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def server_bytes(n: Column) -> Column:
    """The server's short form: GB with one place, else whole MB; halves go to the even digit."""
    giga, mega = F.format_string("%.1f GB", F.bround(n / float(1024**3), 1)), F.format_string("%.0f MB", F.bround(n / float(1024**2)))
    return F.when(n >= 1024**3, giga).otherwise(mega)


def progress_pct(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total + 0.5)).cast("bigint"))


def minutes_left(progress: Column, duration: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil((duration - progress) / 60)).cast("bigint")


def ratio(progress: Column, duration: Column) -> Column:
    return F.when(duration > 0, progress / duration).otherwise(0.0)


def runtime_label(minutes: Column) -> Column:
    """None for an unknown runtime or one of 0."""
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.when(minutes >= 60, F.concat(hours, F.lit("h "), rest, F.lit("min"))).when(minutes != 0, F.concat(rest, F.lit("min")))


def release_year(date: Column) -> Column:
    return F.left(date, F.lit(4))


def airing_label(date: Column, as_of: Column, season: Column, episode: Column) -> Column:
    """When an episode airs or that it did; ``as_of`` in seconds since the epoch, dates at midnight UTC; null for what is no date."""
    at = F.unix_timestamp(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))
    left = at - as_of
    days, hours, minutes = F.floor(left / 86400), F.floor(left % 86400 / 3600), F.floor(left % 3600 / 60)
    text = lambda *p: F.concat(*[x.cast("bigint").cast("string") if isinstance(x, Column) else F.lit(x) for x in p])
    return F.concat(F.lit("S"), season.cast("string"), F.lit("E"), episode.cast("string"), F.lit(" "), _airs(left, text, days, hours, minutes))


def _airs(left: Column, text, days: Column, hours: Column, minutes: Column) -> Column:
    return F.when(left <= 0, "aired").when(days > 0, text("in ", days, "d ", hours, "h")).when(hours > 0, text("in ", hours, "h ", minutes, "m")).when(left > 0, text("in ", F.greatest(F.lit(1), minutes), "m"))


def entry_title(orphan: Column, info_hash: Column, title: Column, series: Column, season: Column, episode: Column) -> Column:
    """Only a series has season and episode in its title, and only where both are known and not 0."""
    two = lambda n: F.when(n >= 10, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
    part = F.when(series & (season != 0) & (episode != 0), F.concat(F.lit(" · S"), two(season), F.lit("E"), two(episode))).otherwise("")
    return F.when(orphan, F.concat(F.lit("Orphaned ("), F.left(info_hash, F.lit(12)), F.lit("…)"))).otherwise(F.concat(F.coalesce(title, F.lit("Untitled")), part))


def display_title(title: Column, name: Column, info_hash: Column) -> Column:
    """The title, else the name, else the start of the hash; empty ones count as none."""
    known = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(known(title), known(name), F.concat(F.left(info_hash, F.lit(10)), F.lit("…")))


def episode_label(season: Column, episode: Column) -> Column:
    return F.concat(F.lit("S"), season.cast("string"), F.lit("E"), episode.cast("string"))


def description(*parts: Column) -> Column:
    """The known, non-empty parts; null if there is none."""
    return F.nullif(F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def release_description(codec: Column, audio: Column, source_type: Column, hdr: Column, imax: Column, seeders: Column, status: Column) -> Column:
    """FN9 of a release: what it is, how many seed it, and the state of its download."""
    seeds = F.concat(seeders.cast("string"), F.lit(" seeds"))
    return description(codec, audio, source_type, F.when(hdr, "HDR"), F.when(imax, "IMAX"), seeds, status_label(status, DOWNLOAD_LABELS))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def look_up(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), value)


def iso639(code: Column, table: dict[str, str]) -> Column:
    """Three letters for two; unknown codes pass through."""
    return F.coalesce(look_up(code, table), code)


def codec_name(media_type: Column, version: Column, layer: Column) -> Column:
    """The short name; MPEG by version and layer; for unknown types the part behind the last slash without ``x-``."""
    video = F.when(version == 1, "mpeg1video").when(version == 2, "mpeg2video").otherwise("mpeg4")
    audio = F.when((version == 1) & F.coalesce(layer == 3, F.lit(False)), "mp3").when(version == 1, "mp2").otherwise("aac")
    rest = F.regexp_replace(F.regexp_replace(media_type, "^.*/", ""), "^(x-)+", "")
    return F.when(media_type == "video/mpeg", video).when(media_type == "audio/mpeg", audio).otherwise(F.coalesce(look_up(media_type, CODEC_NAMES), rest, F.lit("unknown")))


def container_name(media_type: Column) -> Column:
    return F.coalesce(look_up(media_type, CONTAINER_NAMES), media_type)


def bit_depth(profile: Column) -> Column:
    return F.when(F.contains(profile, F.lit("10")), 10).when(F.contains(profile, F.lit("12")), 12)


def is_text_subtitle(media_type: Column) -> Column:
    return media_type.isin(TEXT_SUBTITLES)


def channel_label(channels: Column) -> Column:
    found = F.lit(None).cast("string")
    for n, label in CHANNELS.items():
        found = F.when(channels == n, label).otherwise(found)
    return found


def track_name(title: Column, channels: Column, codec: Column) -> Column:
    return F.coalesce(title, F.trim(F.concat_ws(" ", F.upper(codec), channel_label(channels))))


def bitrate_kbps(height: Column) -> Column:
    found = F.lit(HIGHEST_BIT_RATE)
    for most, rate in sorted(BIT_RATES, reverse=True):
        found = F.when(height <= most, rate).otherwise(found)
    return found


def device_kind(width: Column) -> Column:
    return F.when(width < 768, "phone").when(width < 1024, "tablet").otherwise("desktop")


def status_label(status: Column, table: dict[str, str]) -> Column:
    return F.coalesce(look_up(status, table), status)


def output_name(download_id: Column, only_audio: Column, audio_index: Column) -> Column:
    return F.concat(F.lit("pretranscoded/"), download_id.cast("string"), F.when(only_audio, "_audio_").otherwise("_full_"), audio_index.cast("string"), F.lit(".mp4"))


def parsed_output(path: Column) -> Column:
    pattern = r"^pretranscoded/(\d+)_(audio|full)_(\d+)\.mp4$"
    part = lambda k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return F.struct(part(1).try_cast("bigint").alias("download_id"), (part(2) == "audio").alias("only_audio"), part(3).try_cast("int").alias("audio_index"))


def vtt_time(seconds: Column) -> Column:
    ms = F.greatest(F.lit(0), F.round(seconds * 1000)).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def srt_seconds(text: Column) -> Column:
    """``HH:MM:SS,mmm`` or with a point; null for anything else."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("double")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def search_key(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit("."))


def media_type(text: Column) -> Column:
    """``movie`` or ``tv``; anything else is null, for the quarantine."""
    return F.when(F.lower(text).isin("movie", "tv"), F.lower(text))
