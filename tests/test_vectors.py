"""Literal vectors for rules and quirks."""

from pyspark.sql import functions as F

from reelframe.functions import labels as B, releases as R, subtitles as T
from reelframe.operators import images, releases, timeline as L
from reelframe.operators.catalogue import first_wins


def values(spark, column, *texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    return [r.v for r in spark.createDataFrame(rows, "k int, t string").select("k", column(F.col("t")).alias("v")).orderBy("k").collect()]


def test_seeders(spark):
    assert values(spark, lambda t: R.seeders(R.listed_seeders(t)), "Movie\n👤 12 💾 1.5 GB ⚙️ X", "👤 \n👤 7", "👤 99999999999", None) == [12, None, None, None]


def test_size(spark):
    texts = ["💾 1.5 GB ⚙️", "💾 abc GB\n💾 2 PB z", "none"]
    assert values(spark, lambda t: R.size_bytes(R.size_display(t)), "💾 -5 GB x", "💾 1 kb") == [0, 1024]
    assert values(spark, lambda t: R.size_bytes(R.size_display(t)), *texts) == [1610612736, None, None]
    assert values(spark, R.size_display, *texts) == ["1.5 GB", "2 PB", None]


def test_resolution(spark):
    rows = spark.createDataFrame([(1, "torrentio|1080p|BluRay", "x 4k"), (2, None, "Torrentio\n4k HDR"), (3, None, None)], "k int, b string, n string")
    assert [r.v for r in rows.select("k", R.resolution(R.named_resolution(R.lowered(F.col("b")), R.lowered(F.col("n")))).alias("v")).orderBy("k").collect()] == ["1080p", "2160p", None]


def test_quirks(spark):
    assert values(spark, lambda t: R.source_type(F.concat(F.lit("|"), R.lowered(t))), "The Camera") == ["CAM"]
    assert values(spark, lambda b: R.hdr(F.concat(R.lowered(b), F.lit("|x"))), "a|dvdrip", "plain") == [True, False]


def test_score(spark):
    def score(seeders):
        return R.score(F.lit("1080p"), F.lit(seeders).cast("bigint"), F.lit("WEB-DL"), F.lit("AAC"), F.lit(2 * 10**9))

    row = spark.range(1).select(F.round(score(1), 6).alias("one"), F.round(score(None), 6).alias("unknown")).first()
    assert (row.one, row.unknown) == (7.2, 21.6)


def test_merge_order(spark):
    rows = spark.createDataFrame([(0, 0, "h", "torr", 5), (1, 0, "h", "torrentio", None), (2, 0, "h", "media", 9), (0, 1, "i", "torrentio", 1), (1, 1, "i", "torr", 2)], "source_idx int, pos int, info_hash string, source string, seeders long")
    for c in ["file_idx", "size_bytes"]:
        rows = rows.withColumn(c, F.lit(1).cast("bigint"))
    for c in ["size_display", "resolution", "codec", "audio", "source_type"]:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumns({"hdr": F.lit(False), "imax": F.lit(False)}).withColumn("score", R.score(F.col("resolution"), F.col("seeders"), F.col("source_type"), F.col("audio"), F.col("size_bytes")))
    found = {r.info_hash: (r.sources, r.seeders) for r in releases.merge(rows).collect()}
    assert found == {"h": ("torr, torrentio, media", 9), "i": ("torrentio", 2)}


def test_first_list_keeps_repeats(spark):
    rows = spark.createDataFrame([(0, 0, "movie", 1), (0, 1, "movie", 1), (1, 0, "movie", 1), (1, 1, "movie", 2)], "list_idx int, pos int, media_type string, id int")
    assert sorted(r.id for r in first_wins(rows).collect()) == [1, 1, 2]


def test_sdh(spark):
    texts = ["CAPTAIN: Raise the sails", "DR JONES-LEE: Next, please", "[wind howls]", "(quietly) not here", "[bell rings] We are late", "Wait (coughs) a moment", "♫ ~ #", "♪", "# tra la la #", "Who: the owl", "a [b (c] d) e", "x] y"]
    assert values(spark, T.clean_sdh, *texts) == ["Raise the sails", "Next, please", "", "not here", "We are late", "Wait  a moment", "", "", "# tra la la #", "Who: the owl", "a  e", "x y"]


def test_ass_and_entities(spark):
    assert values(spark, T.ass_text, r"7,1,Sign,,0,0,0,,{\pos(3,4)}North, {\b1}then\hwest{\b0}\nhome", "no fields {here} at all") == ["North, then west\nhome", "no fields  at all"]
    assert values(spark, lambda t: T.unescape(T.strip_tags_embedded(t)), "<b>salt &amp;lt; pepper</b> > all <u") == ["salt &lt; pepper > all"]


def test_cues(spark):
    text = "\ufeff9\r\n00:01:02,250 --> 00:01:04.500\r\nA <i>rainy</i> day\n\nx\n01:00:00,000 --> 01:00:00,750\nin\nthree\nlines\n\n3\nlater --> never\nlost"
    cues = spark.createDataFrame([(text,)], "t string").select(F.explode(F.filter(F.transform(T.blocks(F.col("t")), T.block_cue), lambda c: c.isNotNull())).alias("c")).select("c.*").collect()
    assert [(c.start, c.end, c.text) for c in cues] == [(62.25, 64.5, "A <i>rainy</i> day"), (3600.0, 3600.75, "in\nthree\nlines")]


def starts(spark, seconds, duration):
    row = spark.range(1).select(F.lit([int(s * 10**9) for s in seconds]).cast("array<bigint>").alias("series"), F.lit(int(duration * 10**9)).cast("bigint").alias("duration_ns"), F.lit(1).alias("file_id"))
    return [r.start_ns / 10**9 for r in L.segments(row).orderBy("idx").collect()]


def test_segments(spark):
    # A series, a length and the starts that belong to them.
    assert starts(spark, [0, 2, 5, 6, 11, 30], 40) == [0, 5, 11, 30]
    assert starts(spark, [], 12.5) == [0, 4, 8]
    assert starts(spark, [], 14) == [0, 4, 8, 12]
    # Cases of our own: a start just 4 s on, one that ends too soon, frames only at the very end.
    assert starts(spark, [3.5, 4, 7.5, 8.25, 15], 16) == [0, 4, 8.25]
    assert starts(spark, [9.5], 10) == [0] and starts(spark, [], 4) == [0] and starts(spark, [], 9) == [0, 4]


def test_pieces(spark):
    rows = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, True)], "file_id int, piece int, have boolean")
    assert [r.level for r in L.piece_buckets(rows).orderBy("bucket").collect()] == [255, 0, 255]


def test_letterbox(spark):
    # The size of the frame, its lit rows and how bright they are.
    rows = spark.range(6000).select(F.lit(1).alias("film"), F.lit(1).alias("frame"), F.floor(F.col("id") / 100).alias("y"), (F.col("id") % 100).alias("x"))
    found = images.letterbox(rows.withColumn("luma", F.when(F.col("y").between(10, 49), 120).otherwise(16))).first()
    assert (found.w, found.h) == (100, 40)
    # A case of our own: bars on all sides in one frame, a dark frame, and a frame that is wider but not taller.
    lit = lambda film, frame, top, bottom, left, right: [(film, frame, y, x, 90 if top <= y <= bottom and left <= x <= right else 3) for y in range(20) for x in range(30)]
    frames = spark.createDataFrame([*lit(1, 1, 5, 14, 8, 20), *lit(1, 2, 0, -1, 0, -1), *lit(1, 3, 6, 14, 2, 27)], "film int, frame int, y int, x int, luma int")
    one = images.letterbox(frames).first()
    assert (one.w, one.h, one.aspect) == (13, 10, 1.3)


def test_palette_takes_no_bucket_twice(spark):
    pixels = spark.range(4000).select((F.col("id") % 3).alias("image_id"), F.col("id").alias("y"), F.lit(0).alias("x"), (F.col("id") * 37 % 256).cast("int").alias("r"), (F.col("id") * 91 % 256).cast("int").alias("g"), (F.col("id") * 13 % 256).cast("int").alias("b"))
    picked = images.palette(images.shaded(images.histogram(pixels)))
    rows = picked.collect()
    assert len(rows) == len({(r.image_id, r.key) for r in rows}) > 0
    kept = images.distinct_colours(picked).collect()
    assert kept and max(r.place for r in kept) < images.MOST


def test_airing(spark):
    as_of = 1704110400  # 2024-01-01T12:00Z
    label = lambda t: B.airing_label(t, F.lit(as_of), F.lit(2), F.lit(11))
    assert values(spark, label, "2024-01-03", "2023-12-31", "soon") == ["S2E11 in 1d 12h", "S2E11 aired", None]


def test_chain_matches_fold(spark):
    from reelframe.plans.registry import queries

    a = queries()["segments_greedy"](spark, "/root/testdata/sf0.001").select("file_id", "start_ns")
    b = queries()["segments_chained"](spark, "/root/testdata/sf0.001").select("file_id", "start_ns")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_files(spark, tmp_path):
    from reelframe.sources.files import storage_files, subtitle_files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.srt").write_text("1\n2")
    assert [r.content for r in subtitle_files(spark, str(tmp_path)).collect()] == ["1\n2"]
    assert [r.length for r in storage_files(spark, str(tmp_path)).collect()] == [3]
    (tmp_path / "a" / "b" / "c").mkdir(parents=True)
    (tmp_path / "a" / "b" / "c" / "deep.bin").write_bytes(b"12345")
    (tmp_path / "top.bin").write_bytes(b"")
    (tmp_path / "empty").mkdir()
    found = {r.path.split("/")[-1]: r.length for r in storage_files(spark, str(tmp_path)).collect()}
    assert found == {"x.srt": 3, "deep.bin": 5}


def test_sources_that_fail_are_left_out(spark, tmp_path):
    import gzip

    from reelframe.operators.catalogue import listing_rows, unreadable
    from reelframe.sources.files import listing_sources

    (tmp_path / "a.json").write_text('{"streams":[{"infoHash":"h1","name":"n"},{"name":"no hash"}]}')
    (tmp_path / "b.json").write_text("broken")
    (tmp_path / "c").mkdir()
    whole = gzip.compress(b'{"streams":[{"infoHash":"h2"}' + b" " * 50_000 + bytes(range(256)) * 200)
    (tmp_path / "c" / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "c" / "good.json").write_text('{"streams":[{"infoHash":"h3"}]}')
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "gone.json").write_text("{}")
    paths = [str(tmp_path / p) for p in ("a.json", "none.json", "b.json", "c", "d")]
    documents, report = listing_sources(spark, paths)
    # After the plan was made, a file vanishes.
    (tmp_path / "d" / "gone.json").unlink()
    assert [(r.source_idx, r.info_hash, r.file_idx, r.title) for r in listing_rows(documents, "json", "source_idx").orderBy("source_idx").collect()] == [(0, "h1", 0, ""), (3, "h3", 0, "")]
    assert [r.source_idx for r in unreadable(documents, "json").collect()] == [2]
    found = {r.source_idx: (r.source_url, r.n_files, r.n_read) for r in report.collect()}
    assert {k: v[1:] for k, v in found.items() if k != 4} == {0: (1, 1), 1: (0, 0), 2: (1, 1), 3: (2, 1)} and found[4][2] == 0
    assert [found[k][0] for k in range(5)] == paths


def test_vtt_files(spark, tmp_path):
    from reelframe.operators.subtitles import export_vtt, vtt_lines
    from reelframe.sources.files import write_vtt

    cues = spark.createDataFrame([(1, 1, -1.0, 2.0, "b"), (1, 0, 3661.5, 3662.0004, "a & <b>"), (2, 0, 0.0, 1.0, "c")], "track_id int, idx int, start_s double, end_s double, text string")
    write_vtt(vtt_lines(cues), str(tmp_path / "out"))
    expected = "WEBVTT\n\n01:01:01.500 --> 01:01:02.000\na &amp; &lt;b>\n\n00:00:00.000 --> 00:00:02.000\nb\n"
    files = sorted((tmp_path / "out" / "track_id=1").glob("*.txt"))
    assert "".join(f.read_text() for f in files) == expected + "\n"
    assert export_vtt(cues).where("track_id = 1").first().value == expected


def test_long_track_in_several_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from reelframe.operators.subtitles import export_vtt, vtt_lines
    from reelframe.sources.files import write_vtt

    cues = spark.range(900).select(F.lit(7).alias("track_id"), F.col("id").cast("int").alias("idx"), F.col("id").alias("start_s"), (F.col("id") + 1).alias("end_s"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    write_vtt(vtt_lines(cues.orderBy(F.desc("idx"))), str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "track_id=7").glob("*.txt"))
    assert "".join(f.read_text() for f in files) == export_vtt(cues).first().value + "\n"


def test_running_sum_and_ranks_of_one_hot_room(spark):
    import random

    from reelframe.operators.presence import peer_ranks
    from reelframe.operators.running import running_sum

    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 1, 1, 2]), rng.choice([None, 640, 800, 800, 1920]), rng.choice(["remote", "player", None])) for k in range(400)]
    peers = spark.createDataFrame(rows, "client_id int, room int, width int, mode string")
    rank = lambda r: (-1 if r[2] is None else r[2], r[0])
    for found in peer_ranks(peers).collect():
        me = rows[found.client_id]
        larger = sorted((rank(r), r[0]) for r in rows if r[1] == me[1] and r[3] != "remote" and rank(r) > rank(me))
        assert (found.room, found.n_larger, found.next_larger) == (me[1], len(larger), larger[0][1] if larger else None)
    steps = [(k, rng.choice([None, -1, 1, 1])) for k in range(300)]
    got = {r.k: r.total for r in running_sum(spark.createDataFrame(steps, "k int, step int"), ["k"], "step", "total").collect()}
    assert got == {k: sum(s or 0 for _, s in steps[: k + 1]) for k, _ in steps}
    empty = spark.createDataFrame([], "k int, step int")
    assert running_sum(empty, ["k"], "step", "total").collect() == []
