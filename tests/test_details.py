"""Orders, limits and fallbacks that a comparison of rows doesn't see."""

from pyspark.sql import functions as F

from reelframe.functions import labels as B
from reelframe.operators import catalogue as C, compat as K, library as L
from reelframe.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_ordered_outputs(spark):
    q = registry.queries()
    scores = [(-r.score, r.info_hash) for r in q["release_ranked"](spark, SMALL).collect()]
    assert scores == sorted(scores)
    places = [(r.position is None, r.position, r.created_at) for r in q["collection_definitions"](spark, SMALL).collect()]
    assert places == sorted(places, key=lambda p: (p[0], p[1] or 0, p[2]))
    for name in ("downloads_newest", "jobs_newest"):
        rows = [(r.created_at, r.id) for r in q[name](spark, SMALL).collect()]
        assert rows == sorted(rows, reverse=True)
    members = [(r.collection_slug, r.position, -r.added_at) for r in q["collection_items"](spark, SMALL).collect()]
    assert members == sorted(members)


def test_history_joins_before_it_limits(spark):
    history = spark.createDataFrame([(k, k % 3, k, 10, None) for k in range(12)], "seq long, media_id long, seen_at long, position long, download_id long")
    titles = spark.createDataFrame([(1, "one")], "id long, title string")
    downloads = spark.createDataFrame([], "id long, info_hash string, file_idx int")
    assert [r.seq for r in L.recent_history(history, titles, downloads, 3).collect()] == [10, 7, 4]


def test_no_height_limit_and_many_tracks(spark):
    files = spark.createDataFrame([(1, "mp4", "h264", 8, None, None, 4000, ["dts", "opus", "aac"]), (2, None, None, None, None, False, 100, [])], "file_id int, container string, video_codec string, bit_depth int, chroma string, hdr boolean, height int, audio_tracks array<string>")
    clients = spark.createDataFrame([("c", "h264", "aac", "mp4", None)], "client_id string, video_codecs string, audio_codecs string, containers string, max_height int")
    requests = spark.createDataFrame([(k, False, False, False) for k in (0, 2, 7)], "audio_index int, force_video boolean, force_audio boolean, sdr boolean")
    rows = {(r.file_id, r.audio_index): r for r in K.plan(files, clients, requests).collect()}
    assert len(rows) == 6 and all(r.direct is not None for r in rows.values())
    assert (rows[1, 0].audio, rows[1, 2].audio, rows[1, 7].audio) == ("dts", "aac", "dts")
    assert rows[1, 2].video_ok and rows[1, 2].audio_ok and not rows[1, 2].direct and rows[1, 2].video_action == "copy"
    assert not rows[2, 0].direct and rows[2, 0].audio_action == "none" and rows[2, 0].video_action == "transcode"


def test_backdrop_tail_and_fallbacks(spark):
    images = spark.createDataFrame([(1, k, f"/{k % 9}.jpg", 1920, None, k % 4) for k in range(30)] + [(2, 0, "/small.jpg", 100, None, 9)], "id int, pos int, file_path string, width int, lang string, votes int")
    ranked = C.backdrops(images, seed=5)
    rows = sorted(ranked.collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 10)) and len({r.file_path for r in rows}) == 9
    assert rows[0].votes == max(r.votes for r in rows)
    weights = [r.weight for r in rows[1:]]
    assert weights == sorted(weights, reverse=True) and all(r.votes <= r.weight < r.votes + 2 for r in rows)
    again = [r.file_path for r in sorted(C.backdrops(images, seed=5).collect(), key=lambda r: r.place)]
    assert again == [r.file_path for r in rows]
    titles = spark.createDataFrame([(1, "/a.jpg"), (2, "/b.jpg"), (3, None)], "id int, backdrop string")
    found = C.with_fallbacks(ranked, titles, "backdrop").where("id > 1").collect()
    assert [(r.id, r.file_path, r.place) for r in found] == [(2, "/b.jpg", 1)]


def test_resume_looks_at_recent_rows_only(spark):
    rows = [(k, k, "movie", None, None, k, 100, 1000) for k in range(30)]
    history = spark.createDataFrame(rows, "seq long, media_id long, media_type string, season int, episode int, seen_at long, position long, duration long")
    assert sorted(r.media_id for r in C.resumable_of_recent(history).collect()) == list(range(10, 30))


def test_server_sizes(spark):
    row = spark.range(1).select(B.server_bytes(F.lit(512 * 2**20)).alias("a"), B.server_bytes(F.lit(3 * 2**29)).alias("b"), B.server_bytes(F.lit(100)).alias("c")).first()
    assert tuple(row) == ("512 MB", "1.5 GB", "0 MB")
