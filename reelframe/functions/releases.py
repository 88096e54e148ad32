"""Release attributes read from noisy listing text, as Column expressions.

All are built-in functions inside whole-stage code; ``name``, ``title``, ``binge`` and ``filename`` are
Columns of strings and may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

U32 = 4294967295

# Labels and patterns in the order in which they are tried.
RESOLUTIONS = ["4k", "2160p", "1440p", "1080p", "720p", "480p"]
CODECS = [("x265", ["x265", "hevc", "h265", "h.265"]), ("x264", ["x264", "avc", "h264", "h.264"]), ("AV1", ["av1"])]
AUDIO = [
    ("TrueHD", ["truehd"]),
    ("Atmos", ["atmos"]),
    ("DTS-HD", ["dts-hd"]),
    ("DTS-X", ["dts-x"]),
    ("DTS-X", ["dtsx"]),
    ("DTS", ["dts"]),
    ("DDP 5.1", ["ddp5.1"]),
    ("DDP 5.1", ["dd+5.1"]),
    ("DDP", ["ddp"]),
    ("DD 5.1", ["dd5.1"]),
    ("DDP", ["dd+"]),
    ("EAC3", ["eac3"]),
    ("AC3", ["ac3"]),
    ("AAC 5.1", ["aac5.1"]),
    ("AAC", ["aac2.0"]),
    ("AAC", ["aac"]),
    ("FLAC", ["flac"]),
    ("Opus", ["opus"]),
]
SOURCE_TYPES = [
    ("BluRay REMUX", ["remux"]),
    ("BluRay", ["bluray", "blu-ray"]),
    ("WEB-DL", ["web-dl", "webdl"]),
    ("WEBRip", ["webrip"]),
    ("HDRip", ["hdrip"]),
    ("BDRip", ["bdrip"]),
    ("BRRip", ["brrip"]),
    ("DVDRip", ["dvdrip"]),
    ("HDTV", ["hdtv"]),
    ("CAM", ["cam"]),
]
UNITS = {"TB": 2**40, "GB": 2**30, "MB": 2**20, "KB": 2**10}

# Score weights.
RESOLUTION_WEIGHT = {"2160p": 100.0, "1440p": 90.0, "1080p": 80.0, "720p": 40.0, "480p": 10.0}
SOURCE_WEIGHT = {"BluRay REMUX": 1.0, "BluRay": 0.95, "WEB-DL": 0.9, "WEBRip": 0.8, "BDRip": 0.7, "BRRip": 0.7, "HDRip": 0.6, "DVDRip": 0.4, "HDTV": 0.4, "CAM": 0.1}
AUDIO_FACTOR = {"AAC": 1.0, "AAC 5.1": 1.0, "AC3": 0.95, "DD 5.1": 0.95, "EAC3": 0.9, "DDP": 0.9, "DDP 5.1": 0.9, "DTS": 0.7, "DTS-HD": 0.7, "DTS-X": 0.7, "TrueHD": 0.7, "Atmos": 0.7, "FLAC": 0.8}
OTHER_RESOLUTION, OTHER_SOURCE, OTHER_AUDIO, NO_SEEDERS = 20.0, 0.5, 0.85, 0.3
SIZE_FACTORS = [(80_000_000_000, 0.5), (40_000_000_000, 0.7)]


def first_match(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The label of the first rule with a pattern in ``text``.

    The rules are one constant array, not a chain of branches: the generated code stays small enough for the
    JVM to compile it.
    """
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(p).alias("pattern")) for label, patterns in rules for p in patterns])
    return F.get(F.filter(table, lambda rule: F.contains(text, rule["pattern"])), F.lit(0))["label"]


def weigh(value: Column, weights: dict[str, float], other: float | None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), value)
    return found if other is None else F.coalesce(found, F.lit(other))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def source_name(url: Column) -> Column:
    """Up to the first dot, behind the prefixes; a pattern is only tried where they may repeat, as it is slow and this is read of every listing."""
    rest = F.when(F.startswith(url, F.lit("https://")), F.substr(url, F.lit(9))).when(F.startswith(url, F.lit("http://")), F.substr(url, F.lit(8))).otherwise(url)
    bare = F.when(F.startswith(rest, F.lit("http")), F.regexp_replace(url, "^(?:https://)*(?:http://)*", "")).otherwise(rest)
    return F.substring_index(bare, ".", 1)


def listed_seeders(title: Column) -> Column:
    """Digits after the first person sign; its line alone decides."""
    return F.nullif(F.regexp_extract(title, r"👤[^\S\n]*([0-9]*)", 1), F.lit("")).try_cast("bigint")


def seeders(listed: Column) -> Column:
    return F.when(listed <= U32, listed)


def size_display(title: Column) -> Column:
    """Number and unit behind a line's first disk sign, on the first line where they can be read as such."""
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    return F.nullif(F.regexp_extract(title, rf"(?m)^[^💾\n]*💾[^\S\n]*({number} [^ \n]*)", 1), F.lit(""))


def size_bytes(display: Column) -> Column:
    number, unit = F.substring_index(display, " ", 1).try_cast("double"), F.upper(F.substring_index(display, " ", -1))
    size = F.floor(number * weigh(unit, {name: float(value) for name, value in UNITS.items()}, None)).cast("bigint")
    return F.when(size < 0, 0).otherwise(size)


def named_resolution(low_binge: Column, low_name: Column) -> Column:
    """The first token that names a resolution: the binge group's before the name's, parts between bars before words."""

    names = "|".join(RESOLUTIONS)
    part, word = rf"(?:^|\|)\s*({names})\s*(?:\||\z)", rf"(?:^|\s)({names})(?:\s|\z)"

    def first(text: Column) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in (part, word)])

    return F.coalesce(first(low_binge), first(low_name))


def resolution(named: Column) -> Column:
    return F.when(named == "4k", "2160p").otherwise(named)


def codec(binge_file: Column) -> Column:
    """Of the binge group and the file name, lowered and joined by a bar."""
    return first_match(binge_file, CODECS)


def audio(file_title: Column) -> Column:
    """Of the file name and the title, lowered and joined by a blank."""
    return first_match(file_title, AUDIO)


def source_type(binge_title: Column) -> Column:
    """Of the binge group and the title, lowered and joined by a bar; ``cam`` is a substring, so "camera" counts; kept on purpose."""
    return first_match(binge_title, SOURCE_TYPES)


def hdr(binge_title: Column) -> Column:
    """``|dv`` also meets ``|dvdrip``; kept on purpose."""
    return F.contains(binge_title, F.lit("hdr")) | F.contains(binge_title, F.lit("dolby vision")) | F.contains(binge_title, F.lit("|dv"))


def imax(*lowered_texts: Column) -> Column:
    hit = F.lit(False)
    for t in lowered_texts:
        hit = hit | F.contains(t, F.lit("imax"))
    return hit


def score(resolution: Column, seeders: Column, source_type: Column, audio: Column, size_bytes: Column) -> Column:
    crowd = F.when(seeders > 0, F.log2(seeders.cast("double") + 1) / 10).otherwise(NO_SEEDERS)
    size = F.lit(1.0)
    for limit, factor in sorted(SIZE_FACTORS):
        size = F.when(size_bytes > limit, factor).otherwise(size)
    return weigh(resolution, RESOLUTION_WEIGHT, OTHER_RESOLUTION) * crowd * weigh(source_type, SOURCE_WEIGHT, OTHER_SOURCE) * weigh(audio, AUDIO_FACTOR, OTHER_AUDIO) * size


def is_content_hash(value: Column) -> Column:
    return value.rlike("^[a-fA-F0-9]{40}$")


def is_video_key(value: Column) -> Column:
    return value.rlike("^[A-Za-z0-9_-]{6,15}$")
