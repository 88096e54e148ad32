"""The release queries merge listings before they parse them, and once."""

import re

import pytest

from pyspark.sql import functions as F

from reelframe.functions import releases as R
from reelframe.operators import releases
from reelframe.plans import registry

SMALL = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return registry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_first_listing_gives_the_attributes(spark):
    rows = [
        (1, 0, "h", 7, "https://b.example", "Film 2160p\n👤 5 💾 2 GB", "b 2160p", None, "film.x265.mkv"),
        (0, 3, "h", 8, "http://a.example", "Film\n👤 2 💾 1.5 GB imax", "a 720p", None, None),
        (0, 4, "h", 9, "http://a.example", "Film bluray\n👤 9", "a 1080p", "a|4k", "film.av1.mkv"),
        (2, 0, "i", 1, "c.example", None, None, None, None),
        (2, 1, "j", 1, "c.example", "💾 3 GB 👤 4", "480p", "x|hdr", "cam.aac"),
        (1, 1, "j", 2, "https://b.example", "webrip", None, None, None),
    ]
    listings = spark.createDataFrame(rows, "source_idx int, pos long, info_hash string, file_idx int, source_url string, title string, name string, binge_group string, filename string")
    found, plain = releases.merge_listings(listings), releases.merge(releases.features(listings))
    assert found.columns == plain.columns
    assert sorted(found.collect(), key=lambda r: r.info_hash) == sorted(plain.collect(), key=lambda r: r.info_hash)
    by = {r.info_hash: r for r in found.collect()}
    assert (by["h"].sources, by["h"].seeders, by["h"].file_idx, by["h"].resolution, by["h"].size_display, by["h"].codec, by["h"].imax) == ("a, b", 9, 8, "720p", "1.5 GB", None, True)
    assert (by["j"].sources, by["j"].seeders, by["j"].resolution, by["j"].source_type) == ("b, c", 4, None, "WEBRip")


def test_popular_hash(spark):
    """A hash leaves a task as one row, however many listings it has."""
    rows = spark.range(0, 20_000, 1, 4).selectExpr("cast(id % 3 as int) AS source_idx", "id AS pos", "'h' AS info_hash", "0 AS file_idx", "'https://s' || id % 3 || '.example' AS source_url", "'👤 ' || id AS title", "'n' AS name", "'b' AS binge_group", "'f' AS filename")
    found = releases.by_hash(releases.noted(rows), ["file_idx", *releases.TEXTS]).collect()
    assert [(r.sources, r.seeders, r.own, r.title) for r in found] == [("s0, s1, s2", 19_999, 0, "👤 0")]


@pytest.mark.parametrize("name", ["release_ranked", "release_topk", "release_merge", "release_estimate"])
def test_one_shuffle_of_unparsed_listings(spark, name):
    plan = plan_of(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning\(info_hash#\d+, \d+\)", plan)) == 1 and not re.search(r"Exchange hashpartitioning\(info_hash#\d+, source#", plan)
    before = plan[plan.rindex("partial_min(") :]
    assert "👤" in before and "truehd" not in before and "💾[" not in before
    assert plan.count("lineitem.parquet") == 1


def test_ranking_sorts_stored_rows(spark):
    """The sort's first reading, for its bounds, ends at a shuffle right below it."""
    assert re.search(r"Exchange rangepartitioning[^\n]*\n[ :|]*\+- Exchange hashpartitioning", plan_of(spark, "release_ranked"))


def test_groups_rank_by_their_best(spark):
    rows = [("a", None, 5.0), ("b", "720p", 7.0), ("c", "720p", 9.0), ("d", "480p", 9.0), ("e", None, 1.0), ("f", None, 5.0)]
    found = releases.top_per_resolution(spark.createDataFrame(rows, "info_hash string, resolution string, score double"), 2).collect()
    assert sorted((r.group_place, r.bucket, r.place, r.info_hash) for r in found) == [(1, "480p", 1, "d"), (2, "720p", 1, "c"), (2, "720p", 2, "b"), (3, "Unknown", 1, "a"), (3, "Unknown", 2, "f")]


def test_sources_are_cut_without_a_pattern(spark):
    urls = ["https://a.b.c", "http://a.b", "a.b", "https://https://http://a.b", "http://https://a.b", "http://http://a", "https://httpa.b", "HTTP://a.b", "https://", "", None]
    found = spark.createDataFrame([(u,) for u in urls], "u string").select(R.source_name(F.col("u")).alias("s"), F.substring_index(F.regexp_replace("u", "^(?:https://)*(?:http://)*", ""), ".", 1).alias("plain"))
    assert all(r.s == r.plain for r in found.collect())
    plan = plan_of(spark, "release_merge")
    assert plan.count("regexp_replace(") == plan.count("THEN regexp_replace(") == 1


def test_estimate_parses_once(spark):
    """No filter looks through the texts a second time; rows without a resolution still leave no group."""
    assert not [line for line in plan_of(spark, "release_estimate").splitlines() if "Filter" in line and "regexp_extract" in line]
    rows = [("a", None, 9.0, 5, "5 B"), ("b", "720p", 7.0, None, "x"), ("c", "720p", 6.0, 3, "3 B"), ("d", "1440p", 1.0, None, "1 PB")]
    found = releases.estimates(spark.createDataFrame(rows, "info_hash string, resolution string, score double, size_bytes long, size_display string")).collect()
    assert sorted((r.resolution, r.n, r.size_bytes, r.size_display, r.place) for r in found) == [("1440p", 1, None, "1 PB", 0), ("720p", 2, 3, "3 B", 2)]
