"""Positions and resuming: the history has one row for each title."""

from reelframe.operators import catalogue as C


def test_the_history_holds_the_last_episode_of_a_title(spark):
    rows = [(1, 7, "tv", 1, 1, 1, 50, 600), (2, 7, "tv", 1, 2, 2, 90, 600), (3, 7, "tv", 1, 2, 3, 0, 600), (4, 7, "tv", 1, None, 4, 99, 600), (5, 8, "movie", None, None, 1, 10, 600), (6, 8, "movie", 1, 1, 2, 590, 600), (7, 9, "movie", None, None, 1, 20, 0)]
    history = spark.createDataFrame(rows, "seq long, media_id long, media_type string, season int, episode int, seen_at int, position long, duration long")
    found = {(r.media_id, r.season, r.episode): r.position for r in C.title_positions(history).collect()}
    assert found == {(7, 1, 2): 90, (8, None, None): 590, (9, None, None): 20}
    assert {(r.media_id, r.episode) for r in C.resumable(history).collect()} == {(7, 2)}


def test_the_newest_rows_are_taken_before_the_file_is_asked_for(spark):
    rows = [(k, k, "movie", None, None, k, 100, 1000, "h" if k % 2 else "") for k in range(30)] + [(99, 29, "movie", None, None, 99, 5, 1000, None)]
    history = spark.createDataFrame(rows, "seq long, media_id long, media_type string, season int, episode int, seen_at long, position long, duration long, info_hash string")
    assert sorted(r.media_id for r in C.detail_resume(history).collect()) == [11, 13, 15, 17, 19, 21, 23, 25, 27]
