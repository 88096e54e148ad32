"""Release ranking: features, duplicate merge, order, best few per resolution, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.functions import releases as R


TEXTS = ["title", "name", "binge_group", "filename"]


def noted(listings: DataFrame) -> DataFrame:
    """What a merge needs of every listing: its source and seeders; its texts stay as they are."""
    listed = listings.select("source_idx", "pos", "info_hash", "file_idx", R.source_name(F.col("source_url")).alias("source"), R.listed_seeders(F.col("title")).alias("listed"), *TEXTS)
    return listed.select("source_idx", "pos", "info_hash", "file_idx", "source", R.seeders(F.col("listed")).alias("seeders"), *TEXTS)


def attributes(rows: DataFrame) -> DataFrame:
    """``rows`` with attributes and the score in place of their texts: lowered texts, parsed parts, attributes of them.

    Each text is lowered once, in the first projection; as several attributes use it, Catalyst keeps the
    projections apart and computes it once a row.
    """
    c = F.col
    ids = [x for x in rows.columns if x not in TEXTS]
    low = rows.select(*ids, "title", *[R.lowered(c(x)).alias(x + "_low") for x in TEXTS])
    title, name, binge, file = (c(x + "_low") for x in TEXTS)
    texts = low.select(
        *ids,
        R.size_display(c("title")).alias("size_display"),
        R.named_resolution(binge, name).alias("named"),
        F.concat_ws("|", binge, file).alias("binge_file"),
        F.concat_ws(" ", file, title).alias("file_title"),
        F.concat_ws("|", binge, title).alias("binge_title"),
        R.imax(name, title, file).alias("imax"),
    )
    parsed = texts.select(
        *ids,
        R.size_bytes(c("size_display")).alias("size_bytes"),
        "size_display",
        R.resolution(c("named")).alias("resolution"),
        R.codec(c("binge_file")).alias("codec"),
        R.audio(c("file_title")).alias("audio"),
        R.source_type(c("binge_title")).alias("source_type"),
        R.hdr(c("binge_title")).alias("hdr"),
        "imax",
    )
    return parsed.withColumn("score", R.score(c("resolution"), c("seeders"), c("source_type"), c("audio"), c("size_bytes")))


def features(listings: DataFrame) -> DataFrame:
    """RF1-RF10 in projections, no shuffle."""
    return attributes(noted(listings))


def joined_names(ordered: Column) -> Column:
    """Names in order, each left out if it already is a part of the text so far."""
    return F.aggregate(ordered, F.lit(""), lambda acc, x: F.when(F.contains(acc, x["source"]), acc).otherwise(F.concat(acc, F.when(acc == "", "").otherwise(", "), x["source"])))


def by_hash(rows: DataFrame, kept: list[str]) -> DataFrame:
    """One row per content hash: ``kept`` of its first row and that row's own seeders, all sources, the most seeders.

    A list has one source and sources are few, so partial aggregation keeps one row and one entry per
    source of a hash, and a popular hash never gathers its rows. There is one shuffle.
    """
    found = rows.groupBy("info_hash").agg(
        F.min(F.struct("source_idx", "pos", "seeders", *kept)).alias("first"),
        F.max("seeders").alias("seeders"),
        F.array_sort(F.collect_set(F.struct("source_idx", "source"))).alias("names"),
    )
    return found.select("info_hash", joined_names(F.col("names")).alias("sources"), "seeders", F.col("first.seeders").alias("own"), *[F.col(f"first.{k}").alias(k) for k in kept])


def merge(rows: DataFrame) -> DataFrame:
    """Rows with attributes, one per content hash: the first row's attributes, all sources, the most seeders (AG1)."""
    found = by_hash(rows, ["file_idx", "size_bytes", "size_display", "resolution", "codec", "audio", "source_type", "hdr", "imax", "score"])
    anew = R.score(F.col("resolution"), F.col("seeders"), F.col("source_type"), F.col("audio"), F.col("size_bytes"))
    rose = F.coalesce(F.col("seeders") > F.coalesce("own", F.lit(-1)), F.lit(False))
    return found.withColumn("score", F.when(rose, anew).otherwise(F.col("score"))).drop("own")


def merge_listings(listings: DataFrame) -> DataFrame:
    """``merge`` of the listings' features (AG1), with only the first listing of each hash taken apart.

    The attributes of a hash are its first listing's, so the texts of the others aren't parsed. The most
    seeders are the first's own or more, so the score is always by them.
    """
    return attributes(by_hash(noted(listings), ["file_idx", *TEXTS]).drop("own"))


def ranked(merged: DataFrame) -> DataFrame:
    """Best first; ties by hash (WN5).

    A global sort reads its rows twice, first for the bounds of its ranges. Dealing them out before it lets
    the second reading start from stored rows, not from the merge's last step.
    """
    return merged.repartition("info_hash", "score").orderBy(F.desc("score"), "info_hash")


def top_per_resolution(merged: DataFrame, most: int = 5) -> DataFrame:
    """Best few of each resolution; groups rank by their best score (WN1).

    The filter on ``row_number`` becomes a partial top-k before the shuffle. Groups are ranked over the few
    rows that are left, not by a join with them, which would make the merge a second time.
    """
    merged = merged.withColumn("bucket", F.coalesce("resolution", F.lit("Unknown")))
    inside = Window.partitionBy("bucket").orderBy(F.desc("score"), "info_hash")
    kept = merged.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= most)
    best = kept.withColumn("best", F.max("score").over(Window.partitionBy("bucket")))
    return best.withColumn("group_place", F.dense_rank().over(Window.orderBy(F.desc("best"), "bucket"))).drop("best")


def estimates(merged: DataFrame) -> DataFrame:
    """Per resolution: how many, and the size of the first by score that has one (AG2; 1440p sorts last, kept on purpose).

    Rows without a resolution go by their count, which is 0: a filter on the resolution would be pushed below the
    parsing, and the texts be looked through a second time for it.
    """
    order = F.struct((-F.col("score")).alias("s"), "info_hash")
    found = merged.groupBy("resolution").agg(
        F.count("resolution").alias("n"),
        F.expr("min_by(struct(size_bytes, size_display), struct(-score, info_hash)) FILTER (WHERE size_bytes IS NOT NULL)").alias("sized"),
        F.max_by("size_display", order).alias("last_display"),
    )
    place = F.when(F.col("resolution").isin("4K", "2160p"), 4).when(F.col("resolution") == "1080p", 3).when(F.col("resolution") == "720p", 2).when(F.col("resolution") == "480p", 1).otherwise(0)
    return found.where("n > 0").select("resolution", "n", F.col("sized.size_bytes").alias("size_bytes"), F.coalesce("sized.size_display", "last_display").alias("size_display"), place.alias("place"))
