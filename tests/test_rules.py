"""One literal case for each rule that a comparison with SQL of the same reading can't prove."""

import random

import pytest
from pyspark.sql import functions as F

from reelframe.functions import labels, subtitles as T
from reelframe.operators import catalogue as C, compat as K, grid, mutations as M, running as R, subtitles as S, timeline as L

@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, as they would be with more rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


FILE = "file_id int, container string, video_codec string, bit_depth int, chroma string, hdr boolean, height int, audio_tracks array<string>"
CLIENT = "client_id string, video_codecs string, audio_codecs string, containers string, max_height int"
REQUEST = "audio_index int, force_video boolean, force_audio boolean, sdr boolean"


def planned(spark, file, client=("c", "h264,av1", "aac,flac", "mp4", None), request=(0, False, False, False)):
    files, clients, requests = spark.createDataFrame([(1, *file)], FILE), spark.createDataFrame([client], CLIENT), spark.createDataFrame([request], REQUEST)
    r = K.plan(files, clients, requests).first()
    return r.direct, r.video_action, r.audio_action


def test_only_the_first_track_plays_from_a_plain_url(spark):
    two = ("mp4", "h264", 8, None, False, 720, ["aac", "aac"])
    assert planned(spark, two) == (True, "direct", "direct")
    assert planned(spark, two, request=(2, False, False, False)) == (False, "copy", "copy")
    assert planned(spark, two[:-1] + (["aac"],), request=(2, False, False, False)) == (True, "direct", "direct")


def test_forced_audio_counts_without_audio(spark):
    assert planned(spark, ("mp4", "h264", 8, None, False, 720, []), request=(0, False, True, False)) == (False, "copy", "none")


def test_codec_names_of_the_packager_are_compared_by_letter(spark):
    assert planned(spark, ("mkv", "AV1", 8, None, False, 720, ["FLAC"])) == (False, "transcode", "transcode")
    assert planned(spark, ("mkv", "av1", 8, None, False, 720, ["flac"])) == (False, "copy", "copy")
    assert planned(spark, ("mp4", "H264", 10, None, False, 720, ["AAC"])) == (True, "direct", "direct")
    assert planned(spark, ("mp4", "h264", 10, None, False, 720, ["aac"])) == (False, "transcode", "copy")


def test_heights_of_new_pictures(spark):
    rows = [(1, "c", 2160, 1080, "transcode"), (2, "c", 2160, None, "transcode"), (3, "c", 2160, 1080, "copy"), (4, "c", 720, 1080, "transcode"), (5, "c", 2160, 721, "transcode")]
    rows = spark.createDataFrame(rows, "file_id int, client_id string, height int, max_height int, video_action string").withColumns({"audio_action": F.lit("none"), "hdr": F.lit(True)})
    assert [r.height for r in K.playback_record(rows, 1440).orderBy("file_id").collect()] == [1080, 1440, 2160, 720, 720]
    assert [r.hdr for r in K.playback_record(rows).orderBy("file_id").collect()] == [False, False, True, False, False]
    assert [r.height for r in K.playback_record(rows).orderBy("file_id").collect()] == [1080, 2160, 2160, 720, 720]


def test_many_clients(spark):
    clients = spark.range(20_000).select(F.format_string("c%d", "id").alias("client_id"), F.when(F.col("id") % 2 == 0, "h264").otherwise("hevc").alias("video_codecs"), F.lit("aac").alias("audio_codecs"), F.lit("mp4").alias("containers"), F.lit(None).cast("int").alias("max_height"))
    files = spark.createDataFrame([(k, "mp4", "h264", 8, None, False, 720, ["aac"]) for k in range(3)], FILE)
    rows = K.plan(files, clients, spark.createDataFrame([(0, False, False, False)], REQUEST))
    assert "NestedLoop" not in rows._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.direct, r.n) for r in rows.groupBy("direct").agg(F.count("*").alias("n")).collect()} == {(True, 30_000), (False, 30_000)}


def test_tiles_make_every_pair_once(spark):
    left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(23).withColumnRenamed("id", "b")
    assert sorted(map(tuple, grid.paired(left, right, 5).collect())) == [(a, b) for a in range(50) for b in range(23)]
    assert grid.paired(left, right.limit(0)).count() == 0


def test_other_types_take_the_list_s(spark):
    rows = [(k, p, 1, t, "x", None, None, None) for k in range(3) for p, t in enumerate(["person", "collection", None, "tv"])]
    rows = spark.createDataFrame(rows, "list_idx int, pos int, id int, media_type string, title string, name string, release_date string, first_air_date string")
    found = C.hits(rows, F.when(F.col("list_idx") == 1, "movie").when(F.col("list_idx") == 2, "tv")).orderBy("list_idx", "pos").collect()
    assert [(r.list_idx, r.pos, r.media_type) for r in found] == [(0, 3, "tv"), (1, 0, "movie"), (1, 1, "movie"), (1, 2, "movie"), (1, 3, "tv"), (2, 0, "tv"), (2, 1, "tv"), (2, 2, "tv"), (2, 3, "tv")]


def test_recovery_leaves_finished_jobs_alone(spark):
    rows = spark.createDataFrame([(k, s, 5) for k, s in enumerate(["transcoding", "paused", "completed", "failed", "queued", "cancelled"])], "id int, status string, ms long")
    found = [(r.status, r.ms) for r in M.recovered_jobs(rows, "ms").orderBy("id").collect()]
    assert found == [("queued", 0), ("paused", 0), ("completed", 5), ("failed", 5), ("queued", 5), ("cancelled", 5)]
    downloads = spark.createDataFrame([(1, "downloading"), (2, "paused")], "id int, status string")
    assert [r.status for r in M.recovered_downloads(downloads).orderBy("id").collect()] == ["queued", "paused"]


def test_finished_jobs_are_not_started_anew(spark):
    from reelframe.plans.registry import queries
    from reelframe.sources.carriers import carrier

    small = "/root/testdata/sf0.001"
    before = {r.id: r.transcoded_ms for r in carrier(spark, small, "jobs").where("status = 'completed' AND id % 3 <> 0").collect()}
    after = {r.id: (r.status, r.transcoded_ms) for r in queries()["reset_upsert"](spark, small).collect()}
    assert before and all(after[k] == ("completed", ms) for k, ms in before.items())


def test_system_collections_are_renamed_but_not_deleted(spark):
    rows = spark.createDataFrame([("a", "A", True, True), ("b", "B", True, False)], "slug string, name string, visible boolean, system boolean")
    asked = spark.createDataFrame([("a", "New", False), ("b", None, False)], "slug string, name string, visible boolean")
    assert sorted(map(tuple, M.collection_updates(rows, asked, "slug").collect())) == [("a", "New", False, True), ("b", "B", False, False)]
    stays, refused = M.protected_delete(rows, asked, "slug", F.col("system"))
    assert [r.slug for r in stays.collect()] == ["a"] and [r.slug for r in refused.collect()] == ["a"]


def test_past_the_end_the_first_cue_stands_alone(spark):
    cues = spark.createDataFrame([(1, 0, 1.0, 2.0, "a"), (1, 1, 5.0, 6.0, "b"), (1, 2, 9.0, 10.0, "c")], "track_id int, idx int, start_s double, end_s double, text string")
    points = spark.createDataFrame([(1, t) for t in (0.5, 1.5, 3.0, 5.0, 50.0)], "track_id int, t double")
    found = {r.t: (r.idx, r.previous, r.current, r.next) for r in S.neighbours(cues, points).collect()}
    assert found == {0.5: (0, None, "a", "b"), 1.5: (0, None, "a", "b"), 3.0: (1, "a", "b", "c"), 5.0: (1, "a", "b", "c"), 50.0: (0, None, "a", None)}


def test_neighbours_of_a_hot_track(spark, many_ranges):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2]), None, t := rng.randrange(400), t + rng.randrange(1, 30)) for _ in range(300)]
    places = {}
    rows = [(k, places.setdefault(k, []).append(0) or len(places[k]) - 1, a, b, f"{k}-{a}-{b}") for k, _, a, b in rows]
    cues = spark.createDataFrame(rows, "track_id int, idx int, start_s int, end_s int, text string")
    asked = [(k, t) for k in (1, 2) for t in range(0, 460, 7)]
    for offset in (0, 6):
        found = {(r.track_id, r.t): (r.idx, r.previous, r.current, r.next) for r in S.neighbours(cues, spark.createDataFrame(asked, "track_id int, t int"), offset).collect()}
        for k, t in asked:
            own = [r for r in rows if r[0] == k]
            centre = next((r[1] for r in own if r[2] <= t - offset <= r[3]), next((r[1] for r in own if r[2] > t), None))
            text = lambda p: own[p][4] if 0 <= p < len(own) else None
            assert found[k, t] == ((0, None, text(0), None) if centre is None else (centre, text(centre - 1), text(centre), text(centre + 1)))


def test_the_whole_subtitle_chain(spark):
    text = "1\n00:00:01,000-->00:00:02,000\n<i>kept</i>\n\n2\n00:00:03,000 -->  00:00:04,000\n[humming]\n\n3\n00:00:05,000 --> 00:00:06,000\nMAN: (sighs) Well\n♪\n\n4\n00:00:07,000 --> 00:00:08,000 --> 1\nlost"
    found = S.explode_cues(spark.createDataFrame([(1, text)], "f int, content string"), "f").orderBy("idx").collect()
    assert [(r.idx, r.start, r.end, r.text) for r in found] == [(0, 1.0, 2.0, "kept"), (1, 5.0, 6.0, "Well")]


def test_a_closing_brace_that_closes_nothing_is_text(spark):
    row = spark.range(1).select(T.ass_text(F.lit("a } b {c {d} e} f")).alias("t")).first()
    assert row.t == "a } b  f"


def test_running_values_of_a_hot_group(spark, many_ranges):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "a", None]), k, rng.choice([None, None, rng.randrange(99)])) for k in range(500)]
    table = spark.createDataFrame(rows, "g string, k int, v int").repartition(5)
    assert R.ranged(table, "g", "k").where("g = 'a'").select("block").distinct().count() > 1
    for reverse in (False, True):
        for kind in (R.SUM, R.LAST, R.LEAST):
            got = {r.k: r.w for r in R.running(table, ["g"], ["k"], {"w": "v"}, kind, reverse).collect()}
            for g, k, _ in rows:
                seen = [v for h, j, v in rows if h == g and v is not None and (j >= k if reverse else j <= k)]
                want = sum(seen) if kind == R.SUM else None if not seen else min(seen) if kind == R.LEAST else seen[0] if reverse else seen[-1]
                assert got[k] == want


def test_chained_segments(spark, many_ranges):
    rng = random.Random(6)
    ns = 10**9
    rows, want = [], {}
    for f in range(12):
        end = rng.choice([3, 40, 200]) * ns
        times = sorted({rng.randrange(0, end) for _ in range(rng.choice([1, 40, 150]))})
        rows += [(f, t, end) for t in times for _ in range(rng.choice([1, 2]))]
        starts = [0]
        for t in times:
            if t >= starts[-1] + 4 * ns and t + ns < end:
                starts.append(t)
        want |= {(f, k): t for k, t in enumerate(starts)}
    found = L.chained_segments(spark.createDataFrame(rows, "file_id int, t_ns long, duration_ns long"))
    assert {(r.file_id, r.idx): r.start_ns for r in found.collect()} == want


def test_chained_segments_of_one_long_file(spark):
    frames = spark.range(1_000_000).select(F.lit(1).alias("file_id"), (F.col("id") * 500_000_000).alias("t_ns"), F.lit(500_000 * 10**9).alias("duration_ns"))
    found = L.chained_segments(frames)
    assert found.agg(F.count("*").alias("n"), F.max("idx").alias("last"), F.max("start_ns").alias("end")).first() == (125_000, 124_999, 124_999 * 4 * 10**9)


def test_failure_runs_of_a_hot_key(spark, many_ranges):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, None]), k, rng.random() < 0.7) for k in range(600)]
    found = sorted((r.first_seq, r.n) for r in L.failure_runs(spark.createDataFrame(rows, "key int, seq int, failed boolean").repartition(6), 4).collect())
    want = []
    for key in (1, None):
        run = []
        for _, k, failed in [*[r for r in rows if r[0] == key], (key, 0, False)]:
            run = [*run, k] if failed else want.append((run[0], len(run))) or [] if len(run) >= 4 else []
    assert found == sorted(want)


def test_segments_of_a_hot_file(spark, many_ranges):
    rng = random.Random(7)
    starts = spark.createDataFrame([(1, k, k * 4 * 10**9) for k in range(100)], "file_id int, idx int, start_ns long")
    asked = [(rng.choice([1, 1, 2]), rng.randrange(410) * 10**9 - 2_000_000) for _ in range(500)]
    found = sorted(tuple(r) for r in L.segment_of(starts, spark.createDataFrame(asked, "file_id int, t_ns long")).collect())
    assert found == sorted((f, t, max([k for k in range(100) if f == 1 and k * 4 * 10**9 <= t + 2_000_000], default=0)) for f, t in asked)


def test_chapters_between_which_there_is_none(spark):
    rows = [(1, 10, 20, "a", 60), (1, 30, 40, "b", 60), (2, 0, 9, "only", 60), (3, 0, 9, "a", None), (3, 9, 18, "b", None)]
    chapters = spark.createDataFrame(rows, "file_id int, start_s int, end_s int, title string, duration_s long")
    points = spark.createDataFrame([(f, t) for f in (1, 2, 3) for t in (5, 15, 25, 35, 50)], "file_id int, t int")
    found = {(r.file_id, r.t): (r.title, r.fraction) for r in L.chapter_at(chapters, points).collect()}
    assert found == {(1, 5): (None, None), (1, 15): ("a", 0.5), (1, 25): (None, None), (1, 35): ("b", 0.5), (1, 50): ("b", 1.0)}


def test_labels_of_unknown_things(spark):
    from reelframe.functions import labels as B

    s = lambda *x: [F.lit(v).cast("string") for v in x]
    row = spark.range(1).select(
        B.display_title(*s("", None, "abcdefghijklm")).alias("a"), B.display_title(*s(None, "n", "abc")).alias("b"), B.runtime_label(F.lit(0)).alias("c"), B.runtime_label(F.lit(61)).alias("d"),
        B.episode_label(F.lit(1), F.lit(2)).alias("e"), B.episode_label(F.lit(None).cast("int"), F.lit(2)).alias("f"), B.description(*s("", "x", None, "y")).alias("g"), B.description(*s("", None)).alias("h"),
        B.release_description(*s("x265", None, ""), F.lit(True), F.lit(False), F.lit(0), F.lit("completed")).alias("i"), B.entry_title(F.lit(False), F.lit("h"), F.lit("T"), F.lit(False), F.lit(1), F.lit(2)).alias("j"),
        B.entry_title(F.lit(False), F.lit("h"), F.lit(None).cast("string"), F.lit(True), F.lit(1), F.lit(12)).alias("k"), B.server_bytes(F.lit(2**19)).alias("l"), B.server_bytes(F.lit(3 * 2**19)).alias("m"), B.server_bytes(F.lit(5 * 2**28)).alias("n"),
    ).first()
    assert tuple(row) == ("abcdefghij…", "n", None, "1h 1min", "S1E2", None, "x · y", None, "x265 · HDR · 0 seeds · Downloaded", "T", "Untitled · S01E12", "0 MB", "2 MB", "1.2 GB")


def test_titles_take_the_fields_of_their_kind(spark):
    text = '{"id":1,"title":"Film","name":"Series","runtime":90,"episode_run_time":[45],"imdb_id":"tt1","external_ids":{"imdb_id":"tt2"},"tagline":"So.. it ends..."}'
    rows = spark.createDataFrame([("movie", text), ("tv", text)], "kind string, json string")
    found = {r.media_type: (r.title, r.runtime, r.imdb_id, r.tagline) for r in C.flatten_titles(rows, "json", "kind").collect()}
    assert found == {"movie": ("Film", 90, "tt1", "So.. it ends"), "tv": ("Series", 45, "tt2", "So.. it ends")}


def test_restarted_downloads_keep_what_they_have(spark):
    rows = spark.createDataFrame([(1, "failed", 5, "e"), (2, "completed", 6, "f"), (3, None, 7, "g")], "id int, status string, grown long, error string")
    assert [tuple(r) for r in M.restarted(rows).orderBy("id").collect()] == [(1, "queued", 5, None), (2, "completed", 6, "f"), (3, None, 7, "g")]


def test_actions_on_jobs_apply_where_they_may(spark):
    rows = [(10 * i + j, s, a) for i, s in enumerate(M.STATES) for j, a in enumerate(M.JOB_ACTIONS)]
    table = spark.createDataFrame(rows, "id int, status string, action string")
    found = {r.id: r.status for r in M.transitions(table.select("id", "status"), table.select("id", "action"), M.JOB_ACTIONS).where("applied").collect()}
    by = {(s, a): found.get(i) for i, s, a in rows}
    assert {s for s in M.STATES if by[s, "claim"] == "transcoding"} == {"queued"} and {s for s in M.STATES if by[s, "stop"] == "cancelled"} == {"transcoding"}
    assert {s for s in M.STATES if by[s, "abort"] == "failed"} == {"downloading", "transcoding", "completed", "failed"}
    assert {s for s in M.STATES if by[s, "pause"] == "paused"} == {"queued", "transcoding"} and {s for s in M.STATES if by[s, "queue"] == "queued"} == {"paused"}


def test_names_between_bars_and_repeated_schemes(spark):
    from reelframe.functions import releases as Q

    row = spark.range(1).select(Q.named_resolution(F.lit("a|\n1080p \t|b"), F.lit("")).alias("a"), Q.source_name(F.lit("https://https://http://x.y")).alias("b"), Q.named_resolution(F.lit("x1080p"), F.lit("p 720p\n")).alias("c")).first()
    assert tuple(row) == ("1080p", "x", "720p")


def test_presentation_times(spark):
    decode = spark.createDataFrame([(1, 0, 3, 10), (1, 1, 2, 20), (2, 0, 2, 10**10)], "file_id int, run int, n long, delta long")
    composition = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 0, 99), (1, 2, 2, -7)], "file_id int, run int, n long, offset long")
    tracks = spark.createDataFrame([(1, 6, 30), (2, None, 90000)], "file_id int, media_time long, timescale long")
    found = {(r.file_id, r.sample): r.t for r in L.presentation_times(decode, composition, tracks).collect()}
    ticks = [0 + 5 - 6, 10 - 7 - 6, 20 - 7 - 6, 30 - 6, 50 - 6]
    assert found == {(1, k): max(t, 0) * 10**9 // 30 for k, t in enumerate(ticks)} | {(2, 0): 0, (2, 1): 10**19 // 90000}


def test_halves_of_sizes_are_rounded_as_the_sql_rounds_them(spark):
    from reelframe.plans.registry import queries

    sizes = [184832, 185856, 180 * 2**20 + 2**19, 2**30 + 2**28, 2**30 + 3 * 2**28, 512, 2**40 + 2**39]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long")
    found = rows.select(labels.human_bytes(F.col("n"), even=True).alias("even"), labels.human_bytes(F.col("n")).alias("up")).collect()
    assert [r.even for r in found] == ["180 KB", "182 KB", "180 MB", "1.2 GB", "1.8 GB", "512 B", "1.50 TB"]
    assert [r.up for r in found] == ["181 KB", "182 KB", "181 MB", "1.3 GB", "1.8 GB", "512 B", "1.50 TB"]
    assert queries()["scalar_labels"](spark, "/root/testdata/sf0.1").where("id = 30014").first().size == "180 KB"


def test_pairs_of_a_large_room_are_made_by_blocks(spark):
    from reelframe.operators.presence import larger_peers

    draw = random.Random(4)
    rows = [(k, None if k % 50 == 0 else k % 2, None if k % 31 == 0 else draw.randrange(40), "remote" if k % 5 == 0 else "player") for k in range(300)]
    peers = spark.createDataFrame(rows, "client_id int, room int, width int, mode string")
    found = larger_peers(peers, block=32)
    expected = {(a, b) for a, r, w, _ in rows for b, s, v, mode in rows if r is not None and r == s and mode != "remote" and None not in (w, v) and (v, b) > (w, a)}
    pairs = [tuple(p) for p in found.collect()]
    assert len(pairs) == len(expected) and set(pairs) == expected
    # More tasks than rooms have a share.
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_what_the_pairs_of_a_room_are_made_of_grows_with_its_peers(spark):
    from reelframe.operators.presence import larger_peers

    def written() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    sent = []
    for n in (2000, 8000):
        before = written()
        peers = spark.range(n).selectExpr("id AS client_id", "1 AS room", "cast(id * 7919 % 500 AS int) AS width", "'player' AS mode")
        assert larger_peers(peers, block=64).count() == n * (n - 1) // 2
        sent.append(written() - before)
    assert sent[1] < 6 * sent[0]


def test_pairs_of_equal_and_nameless_peers(spark):
    from reelframe.operators.presence import larger_peers

    draw = random.Random(5)
    rows = [(draw.choice([None, None, *range(12)]), draw.choice([None, 1, 1, 1, 2, 3]), draw.choice([None, 5, 5, 5, 6, 9]), draw.choice([None, "remote", "player", "player"])) for _ in range(400)]
    rows += [(k, 100 + k, k % 3, "player") for k in range(40)] + [(7, 8, 5, "player")] * 90 + [(None, 8, 5, "player")] * 90
    peers = spark.createDataFrame(rows, "client_id int, room int, width int, mode string")
    above = lambda a, b: b[2] > a[2] or (b[2] == a[2] and a[0] is not None and b[0] is not None and b[0] > a[0])
    full = [r for r in rows if r[1] is not None and r[2] is not None]
    expected = sorted(((a[0], b[0]) for a in full for b in full if a[1] == b[1] and b[3] not in (None, "remote") and above(a, b)), key=str)
    for block in (16, 4096):
        assert sorted(map(tuple, larger_peers(peers, block=block).collect()), key=str) == expected
    assert larger_peers(peers.limit(0)).count() == 0


def test_each_entry_is_made_once_for_its_categories(spark):
    from reelframe.operators import library

    small = "/root/testdata/sf0.001"
    from reelframe.plans.registry import queries

    found = queries()["library_categories"](spark, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Downloads, jobs and orphans are joined once, not once for each category.
    assert plan.count("Generate explode") == 1 and plan.count("Join") <= 9
    rows = spark.createDataFrame([("job", (1, "movie"), None, None, 5), ("download", None, (2, None), None, 7), ("orphan", None, None, ("h", 3), 3)], "kind string, job struct<id: int, media_type: string>, download struct<id: int, media_type: string>, orphan struct<hash: string, bytes: long>, bytes long")
    shown = sorted((r.category, r.kind) for r in library.by_category(rows).collect())
    assert shown == sorted((name, r.kind) for name in library.CATEGORIES for r in library.category(rows, name).collect())


def test_pieces_are_read_once(spark):
    pieces = spark.range(600).select(F.lit(1).alias("file_id"), F.col("id").alias("piece"), (F.col("id") < 300).alias("have"))
    found = L.piece_buckets(pieces)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.level for r in found.orderBy("bucket").collect()] == [255] * 100 + [0] * 100


def test_details_resume_from_all_titles(spark):
    from reelframe.plans.registry import queries

    small = "/root/testdata/sf0.01"
    every, recent = (queries()[name](spark, small).collect() for name in ("resume_detail_hash", "resume_detail_recent"))
    assert len(every) > 20 >= len(recent) and set(recent) <= set(every)
