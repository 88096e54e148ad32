"""Subtitle-corpus jobs: cues, cleaning, look-up, export (SB*, JN11, JN18, WN2, SC7, SC11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelframe.functions import labels, subtitles as T
from reelframe.operators.running import LEAST, running

#: Seconds in a look-up bucket.
BUCKET = 16


def explode_cues(files: DataFrame, *keys: str) -> DataFrame:
    """SB1, SB2, SB4: the whole chain, one row per readable cue with its tags and sounds taken out; no shuffle.

    A cue of which nothing is left is dropped; the others are numbered in input order.
    """
    cues = F.filter(F.transform(T.blocks(F.col("content")), T.block_cue), lambda c: c.isNotNull())
    cleaned = F.transform(cues, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), T.clean_sdh(T.strip_tags(c["text"])).alias("text")))
    kept = F.filter(cleaned, lambda c: c["text"] != "")
    return files.select(*keys, F.posexplode(kept).alias("idx", "cue")).select(*keys, "idx", "cue.start", "cue.end", "cue.text")


def cue_at(cues: DataFrame, points: DataFrame, offset: float = 0) -> DataFrame:
    """JN11: the first cue of the track that holds each point less ``offset`` (seconds by which subtitles are shifted), ends included.

    Both sides meet on (track, bucket), so a long track is many small joins; a cue stands in each bucket
    that it touches.
    """
    spread = cues.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_s") / BUCKET), F.floor(F.col("end_s") / BUCKET))))
    placed = points.withColumn("at", F.col("t") - F.lit(offset)).withColumn("bucket", F.floor(F.col("at") / BUCKET))
    inside = (F.col("at") >= F.col("start_s")) & (F.col("at") <= F.col("end_s"))
    hits = placed.join(spread, ["track_id", "bucket"]).where(inside)
    best = hits.groupBy("track_id", "t").agg(F.min("idx").alias("idx"))
    return points.join(best, ["track_id", "t"], "left")


def following(cues: DataFrame, points: DataFrame) -> DataFrame:
    """The first cue of the track, by number, of those that start after each point: (track_id, t, later), carried back over ranges."""
    both = cues.select("track_id", F.col("start_s").cast("double").alias("at"), F.lit(0).alias("kind"), F.col("idx").cast("bigint").alias("idx"), F.lit(None).cast(points.schema["t"].dataType).alias("t"))
    both = both.groupBy("track_id", "at", "kind", "t").agg(F.min("idx").alias("idx"))
    some = points.select("track_id", F.col("t").cast("double").alias("at"), F.lit(1).alias("kind"), "t", F.lit(None).cast("bigint").alias("idx")).distinct()
    found = running(both.unionByName(some), ["track_id"], ["at", "kind"], {"later": "idx"}, LEAST, reverse=True)
    return found.where("kind = 1").select("track_id", "t", "later")


def neighbours(cues: DataFrame, points: DataFrame, offset: float = 0) -> DataFrame:
    """JN18: previous, current and next cue; ``idx`` counts a track's cues without gaps.

    The centre is the active cue by the time less ``offset``, else the first to start after the time itself; past the
    end there is no centre, and the track's first cue stands alone (all kept on purpose).
    """
    active = cue_at(cues, points, offset).join(following(cues, points), ["track_id", "t"], "left")
    first = cues.groupBy("track_id").agg(F.min("idx").alias("first"))
    centre = active.join(first, "track_id").select("track_id", "t", F.coalesce("idx", "later").alias("found"), F.coalesce("idx", "later", "first").cast("bigint").alias("idx"))
    offsets = F.when(F.col("found").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    wanted = centre.select("track_id", "t", "idx", F.explode(offsets).alias("by")).withColumn("place", F.col("idx") + F.col("by"))
    texts = wanted.join(cues.select("track_id", F.col("idx").cast("bigint").alias("place"), "text"), ["track_id", "place"])
    of = lambda by: F.max(F.when(F.col("by") == by, F.col("text")))
    return texts.groupBy("track_id", "t", "idx").agg(of(-1).alias("previous"), of(0).alias("current"), of(1).alias("next"))


def duplicate_labels(tracks: DataFrame, keys: list[str], name: Column, order: str) -> DataFrame:
    """WN2: `` #n`` behind names that several tracks share."""
    same = Window.partitionBy(*keys)
    n, k = F.count("*").over(same), F.row_number().over(same.orderBy(order))
    return tracks.withColumn("label", F.when(n > 1, F.concat(name, F.lit(" #"), k.cast("string"))).otherwise(name))


def _vtt_line() -> Column:
    return F.concat(labels.vtt_time(F.col("start_s")), F.lit(" --> "), labels.vtt_time(F.col("end_s")), F.lit("\n"), T.vtt_escape(F.col("text")), F.lit("\n"))


def export_vtt(cues: DataFrame) -> DataFrame:
    """SC11 as one value per track, cues in order; for tracks that fit in a row. :func:`vtt_lines` has no such bound."""
    listed = cues.select("track_id", F.struct("idx", _vtt_line().alias("line")).alias("c")).groupBy("track_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return listed.select("track_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("cs", lambda c: c["line"]), "\n")).alias("value"))


def vtt_lines(cues: DataFrame) -> DataFrame:
    """SC11 for tracks of any length: the pieces of each document by (track_id, idx), its head at -1; see ``write_vtt``."""
    heads = cues.select("track_id").distinct().select("track_id", F.lit(-1).alias("idx"), F.lit("WEBVTT\n").alias("value"))
    return heads.union(cues.select("track_id", "idx", _vtt_line().alias("value")))


def select_tracks(tracks: DataFrame, languages: list[str]) -> DataFrame:
    """SB8, PF11, WN6: tracks of allowed languages after mapping, best score first."""
    code = labels.iso639(F.lower("language"), labels.LISTING_LANGUAGES)
    kept = tracks.withColumns({"code": code, "score": F.coalesce(F.col("score").try_cast("bigint"), F.lit(0))})
    return kept.where(F.col("code").isin(languages)).orderBy(F.desc("score"), "track_id")


def union_tracks(embedded: DataFrame, external: DataFrame) -> DataFrame:
    """SO3: embedded tracks (score 1000, language ``und`` by default) before external ones."""
    own = embedded.withColumns({"language": F.coalesce("language", F.lit("und")), "score": F.lit(1000).cast("bigint"), "rank": F.lit(0)})
    return own.unionByName(external.withColumn("rank", F.lit(1)))


def first_non_empty(tracks: DataFrame, key: str) -> DataFrame:
    """AG13: of each key's tracks the first with cues, by rank then score."""
    return tracks.where("n_cues > 0").groupBy(key).agg(F.min_by("track_id", F.struct("rank", -F.col("score"), "track_id")).alias("track_id"))
