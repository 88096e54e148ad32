"""Storage accounting (AG3-AG5, JN8-JN9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def located(files: DataFrame) -> DataFrame:
    """Area and content directory from each path; ``name`` as on disk, ``hash`` in lower case."""
    part = lambda k: F.regexp_extract("path", r"^/data/([a-z]+)/([^/]+)/", k)
    return files.select(part(1).alias("area"), part(2).alias("name"), F.lower(part(2)).alias("hash"), "path", "length")


def dir_sizes(files: DataFrame) -> DataFrame:
    return located(files).groupBy("area", "hash").agg(F.sum("length").alias("bytes"), F.count("*").alias("n_files"))


def orphans(files: DataFrame, downloads: DataFrame) -> DataFrame:
    """JN8: directories, by their name on disk, that no download names, letter case aside; sizes are summed before the join."""
    sized = located(files.where("path LIKE '/data/downloads/%'")).groupBy("name", "hash").agg(F.sum("length").alias("bytes"))
    known = downloads.select(F.lower("info_hash").alias("hash")).distinct()
    return sized.join(known, "hash", "left_anti").select(F.col("name").alias("hash"), "bytes")


def with_disk_bytes(downloads: DataFrame, files: DataFrame) -> DataFrame:
    """Downloads with the bytes of their directory (``disk_bytes``), 0 where there is none; each of one hash has all of them."""
    sized = located(files).where("area = 'downloads'").groupBy("hash").agg(F.sum("length").alias("_bytes"))
    joined = downloads.join(sized, F.lower(downloads["info_hash"]) == sized["hash"], "left")
    return joined.select(*[downloads[c] for c in downloads.columns], F.coalesce("_bytes", F.lit(0)).alias("disk_bytes"))


def missing_files(downloads: DataFrame, files: DataFrame) -> DataFrame:
    """JN9: completed rows whose directory is gone."""
    there = located(files).where("area = 'downloads'").select("hash").distinct()
    return downloads.where("status = 'completed'").join(there, F.lower(downloads["info_hash"]) == there["hash"], "left_anti")


def rollup(files: DataFrame, downloads: DataFrame, meta: DataFrame, titles: DataFrame, distinct: bool = False) -> DataFrame:
    """AG3: bytes by area and kind of content, with totals. Two downloads of one hash each count its directory, unless ``distinct``.

    Directories of downloads are of a title's type, ``untitled`` where nothing is known of the title, or ``orphan``
    where no download has them; other areas have no kinds.
    """
    sized = dir_sizes(files)
    keyed = downloads.select(F.lower("info_hash").alias("hash"), "info_hash", "file_idx").join(meta, ["info_hash", "file_idx"], "left")
    keyed = keyed.join(titles.select(F.col("id").alias("media_id"), "media_type"), "media_id", "left").select("hash", "media_type")
    keyed = keyed.withColumn("media_type", F.coalesce("media_type", F.lit("untitled")))
    if distinct:
        keyed = keyed.distinct()
    tracked = sized.where("area = 'downloads'").join(keyed, "hash", "left").select("area", F.coalesce("media_type", F.lit("orphan")).alias("media_type"), "bytes")
    joined = tracked.unionByName(sized.where("area <> 'downloads'").select("area", F.lit("").alias("media_type"), "bytes"))
    return joined.rollup("area", "media_type").agg(F.sum("bytes").alias("bytes"), F.grouping_id().alias("level"))


def shares(files: DataFrame, total: int) -> DataFrame:
    """AG5: each area's percent of the disk and where its slice starts. One row per area meets in the window."""
    by_area = located(files).groupBy("area").agg(F.sum("length").alias("bytes"))
    upto = Window.orderBy("area").rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("bytes") * 100.0 / max(total, 1)
    return _sliced(by_area, share, upto)


def shares_of_used(files: DataFrame, total: int, used: int) -> DataFrame:
    """AG5: as :func:`shares`, with a last slice of what others use: ``used`` less all areas, 0 at least."""
    by_area = located(files).groupBy("area").agg(F.sum("length").alias("bytes")).withColumn("last", F.lit(0))
    own = by_area.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("own"))
    other = own.select(F.lit("other").alias("area"), F.greatest(F.lit(0), F.lit(used) - F.col("own")).cast("long").alias("bytes"), F.lit(1).alias("last"))
    upto = Window.orderBy("last", "area").rowsBetween(Window.unboundedPreceding, -1)
    return _sliced(by_area.unionByName(other), F.col("bytes") * 100.0 / max(total, 1), upto)


def _sliced(by_area: DataFrame, share, upto) -> DataFrame:
    return by_area.select("area", "bytes", F.round(share, 6).alias("percent"), F.round(F.coalesce(F.sum(share).over(upto), F.lit(0.0)), 6).alias("offset"))
