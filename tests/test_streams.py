"""Streams over many files that are not in order of time."""

import os
import shutil

import duckdb
import pytest

from reelframe.plans import registry
from reelframe.streaming import feeds, folds, sessions
from reelframe.streaming.state import KeyedTable

from test_queries import SMALL, plain

FILES = 130
NAMES = ["stream_idle_sessions", "stream_ticks", "stream_complete_once", "stream_failure_alarm", "stream_stats", "roster", "roster_changes", "roster_after", "stream_live_counts"]


@pytest.fixture(scope="module")
def scattered(tmp_path_factory):
    """The given events in files from the newest to the oldest; the file source takes 64 a batch."""
    at = tmp_path_factory.mktemp("scattered")
    (at / "events.parquet").mkdir()
    con = duckdb.connect()
    con.sql(f"CREATE TABLE events AS SELECT *, ntile({FILES}) OVER (ORDER BY ts DESC) AS part FROM '{SMALL}/events.parquet'")
    for k in range(1, FILES + 1):
        file = at / "events.parquet" / f"part-{k:03}.parquet"
        con.sql(f"COPY (SELECT * EXCLUDE part FROM events WHERE part = {k}) TO '{file}'")
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
    shutil.copy(f"{SMALL}/customer.parquet", at / "customer.parquet")
    con.sql(f"CREATE VIEW customer AS SELECT * FROM '{SMALL}/customer.parquet'")
    yield str(at), con
    shutil.rmtree(at)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("small", [False, True])
def test_order_of_files_does_not_matter(spark, scattered, monkeypatch, name, small):
    at, con = scattered
    if small:  # several ranges of time, each a batch or more
        monkeypatch.setattr(feeds, "RANGE_ROWS", 200)
    found = registry.queries()[name](spark, at)
    columns = sorted(found.columns)
    other = con.sql(registry.oracle_sql()[name])
    at = [other.columns.index(c) for c in columns]
    expected = sorted(repr([plain(row[k]) for k in at]) for row in other.fetchall())
    assert expected and sorted(repr([plain(v) for v in row]) for row in found.select(*columns).collect()) == expected


def test_fold_goes_on_where_it_ended_and_reads_its_snapshot_anew(spark, tmp_path):
    schema = "event_ts timestamp, seq long, id long, kind string, done long, total long"
    known = {1}

    def run(rows):
        made = spark.createDataFrame([(1_700_000_000 + t, s, *rest) for t, s, *rest in rows], "t long, seq long, id long, kind string, done long, total long")
        made.selectExpr("timestamp_seconds(t) AS event_ts", "seq", "id", "kind", "done", "total").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        snapshot = lambda: spark.createDataFrame([(k, f"name {k}") for k in sorted(known)], "id long, name string")
        state = folds.fold_latest(stream, "id", ["total"], location=str(tmp_path / "state"), snapshot=snapshot)
        return sorted((r.id, r.seq, r.done, r.total, r.name) for r in state.collect())

    assert run([(1, 1, 1, "progress", 5, 50), (1, 2, 2, "progress", 7, 70)]) == [(1, 1, 5, 50, "name 1")]
    known.add(2)
    # An older event changes nothing; a null total keeps the old one; key 2 is known by now.
    assert run([(0, 0, 1, "progress", 1, None), (2, 4, 2, "progress", 9, None)]) == [(1, 1, 5, 50, "name 1"), (2, 4, 9, 70, "name 2")]
    assert run([(3, 5, 1, "removed", None, None)]) == [(2, 4, 9, 70, "name 2")]
    assert run([(2, 3, 1, "progress", 8, None)]) == [(2, 4, 9, 70, "name 2")]
    changes = tmp_path / "state" / "table" / "changes"
    assert spark.read.parquet(str(changes / "batch=1")).count() == 2 and spark.read.parquet(str(changes / "batch=2")).count() == 1


def table_of(spark, path, every=4, dead=None):
    return KeyedTable(spark, str(path), "id", every, dead)


def test_a_result_reads_few_folders_however_many_batches_there_were(spark, tmp_path):
    table, want = table_of(spark, tmp_path / "t"), {}
    assert table.rows() is None
    for n in range(23):
        rows = [(n % 7, n), (100 + n, n)]
        want |= dict(rows)
        table.put(spark.createDataFrame(rows, "id long, v long").coalesce(1), n)
        assert len(table.folders()) <= 4
        assert {r.id: r.v for r in table.rows().collect()} == want
    assert table.numbers("snapshots") == [15, 19] and min(table.numbers("changes")) > 15
    # The table as of a batch that the folders still tell apart.
    assert max(r.v for r in table.rows(20).collect()) == 20


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", every=2)
    made = lambda n: spark.createDataFrame([(0, n), (n, n)], "id long, v long").coalesce(1)
    for n in (0, 1, 1, 2, 3, 3, 4):
        table.put(made(n), n)
        assert {r.id: r.v for r in table.rows().collect()} == {0: n} | {k: k for k in range(1, n + 1)}
    # A snapshot that was written but not committed, as after a lost driver, is not read.
    made(99).write.parquet(str(tmp_path / "t" / "aside-lost"))
    assert max(r.v for r in table.rows().collect()) == 4


def test_a_batch_fails_before_its_snapshot_is_committed(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    schema = "event_ts timestamp, seq long, id long, kind string, done long"

    def add(k):
        spark.sql(f"SELECT timestamp_seconds({1_700_000_000 + k}) AS event_ts, {k}L AS seq, {k % 3}L AS id, 'progress' AS kind, {k}L AS done").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return sorted((r.id, r.done) for r in folds.fold_latest(stream, "id", [], location=str(tmp_path / "state"), every=2).collect())

    for k in range(4):
        add(k)
        assert run() == sorted({j % 3: j for j in range(k + 1)}.items())
    add(4)
    fold = KeyedTable.fold
    monkeypatch.setattr(KeyedTable, "fold", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    add(5)
    with pytest.raises(Exception, match="lost"):
        run()
        add(6)
        run()
    monkeypatch.setattr(KeyedTable, "fold", fold)
    found = dict(run())
    last = max(found.values())
    assert found == {j % 3: j for j in range(last + 1)} and last >= 5


def test_tombstones_end_with_the_watermark(spark, tmp_path):
    schema = "event_ts timestamp, seq long, id long, kind string, v long"
    places, table = [], None

    def run(rows):
        made = spark.createDataFrame([(1_700_000_000 + t, *rest) for t, *rest in rows], "t long, seq long, id long, kind string, v long")
        made.selectExpr("timestamp_seconds(t) AS event_ts", "seq", "id", "kind", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feeds.drained(sessions.fold_writer(stream, "id", ["v"], str(tmp_path / "state"), places), rocksdb=True)
        return {r.id: (r.kind, r.v) for r in places[-1].rows().collect()}

    def kept():
        """Keys that the state store holds."""
        rows = spark.read.format("statestore").option("path", str(tmp_path / "state" / "checkpoint")).option("stateVarName", "state").load()
        return sorted(r.key.id for r in rows.select("key").collect())

    assert run([(0, 1, 1, "progress", 5), (0, 2, 2, "progress", 6)]) == {1: ("progress", 5), 2: ("progress", 6)}
    assert run([(100, 3, 1, "removed", None)])[1][0] == "removed" and kept() == [1, 2]
    # A late event within the delay is older than the tombstone.
    assert run([(50, 4, 1, "progress", 7)])[1][0] == "removed" and kept() == [1, 2]
    # Past the delay the key has no state; an event that late is dropped, a new one starts anew.
    # (A snapshot in between leaves the ended key out of the table.)
    ended = {None, "ended"}
    assert run([(800, 5, 2, "progress", 8)]).get(1, [None])[0] in ended and kept() == [2]
    assert run([(60, 6, 1, "progress", 9)]).get(1, [None])[0] in ended and kept() == [2]
    assert run([(801, 7, 1, "progress", 10)])[1] == ("progress", 10) and kept() == [1, 2]


def test_ended_keys_leave_snapshots(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", every=2, dead="kind = 'ended'")
    for n, rows in enumerate([[(1, "x"), (2, "x")], [(1, "ended")], [(3, "x")]]):
        table.put(spark.createDataFrame(rows, "id long, kind string").coalesce(1), n)
    assert table.numbers("snapshots") == [1] and {r.id for r in table.rows().collect()} == {2, 3}


def test_sweeps_close_idle_sessions():
    s = sessions.Sessions()
    # 120 s of rest are not too long; the sweep after them is the next whole minute.
    assert sessions.sweep_after(0) == 180_000 and sessions.sweep_after(1) == 180_000 and sessions.sweep_after(59_999) == 180_000 and sessions.sweep_after(60_000) == 240_000
    steps = lambda events, now, state=None: ([(r.moment, r.step) for r in s.apply(1, state, events, now)[0]], s.apply(1, state, events, now)[1])
    assert steps([(0, 1, False), (179_999, 2, False)], 200_000) == ([(0, 1)], (179_999,))
    assert steps([(0, 1, False), (180_000, 2, False)], 200_000) == ([(0, 1), (180_000, -1), (180_000, 1)], (180_000,))
    assert steps([(5, 1, True)], 10) == ([], None)
    assert steps([(5, 1, False), (6, 2, True), (7, 3, True)], 10) == ([(5, 1), (6, -1)], None)
    assert steps([], 180_000, (0,)) == ([(180_000, -1)], None)


def test_the_roster_is_stamped_with_the_connection(spark, tmp_path):
    schema = "event_ts timestamp, seq long, conn long, claimed long, kind string, width long"
    rows = [(k, k, k % 3, 99, "removed" if k % 5 == 4 else "update", k) for k in range(40)] + [(5000, 40, 0, 99, "update", 1)]
    made = spark.createDataFrame([(1_700_000_000 + t, *r) for t, *r in rows], "t long, seq long, conn long, claimed long, kind string, width long")
    made.selectExpr("timestamp_seconds(t) AS event_ts", "seq", "conn", "claimed", "kind", "width").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counted = sessions.counted(sessions.presence_changes(stream, "conn").selectExpr("*", "1L AS one"), ["moment", "seq"], {"n_present": "step", "number": "one"}, str(tmp_path / "out"))
    feeds.drained(counted, rocksdb=True)
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "rows")).select("number", "client_id", "seq", "change", "width", "n_present").collect()))
    here, want = {}, []
    for _, seq, conn, _, kind, width in rows[:-1]:
        if kind == "removed" and conn not in here:
            continue
        change = "left" if kind == "removed" else "updated" if conn in here else "joined"
        shown = here.pop(conn) if kind == "removed" else width
        if kind != "removed":
            here[conn] = width
        want.append((len(want) + 1, conn, seq, change, shown, len(here)))
    assert found == want
    changes = spark.createDataFrame(found, "number long, client_id long, seq long, change string, width long, n_present long")
    for k in (1, 17, len(want)):
        state = {}
        for number, conn, seq, change, width, _ in want[:k]:
            state.pop(conn, None)
            if change != "left":
                state[conn] = (seq, width)
        assert {r.client_id: (r.seq, r.width) for r in sessions.roster_after(changes, k).collect()} == state


def test_runs_of_failures_go_on_between_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "RANGE_ROWS", 40)
    rows = [(k, 1 if k % 4 else 2, "error" if k % 11 else "ok") for k in range(200)]
    spark.createDataFrame([(k, k, u, e) for k, u, e in rows], "event_id long, t long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    events = feeds.OrderedEvents(spark, str(tmp_path / "events.parquet"), ["user_id", "event_type"])
    assert events.staged is not None
    found = folds.failure_alarm(events, lambda r: r.selectExpr("user_id AS key", "event_ts", "seq", "event_type = 'error' AS failed"), 7)
    want, run = [], {}
    for k, u, e in rows:
        run[u] = run.get(u, 0) + 1 if e == "error" else 0
        want += [(u, k)] if run[u] == 7 else []
    assert want and sorted(map(tuple, found.collect())) == sorted(want)


def test_state_has_few_partitions_and_settings_come_back(spark):
    from reelframe.streaming import feeds

    seen = []

    class Writer:
        _spark = spark

        def trigger(self, availableNow):
            seen.append((spark.conf.get(feeds.PARTITIONS), spark.conf.get(feeds.PROVIDER, None)))
            return self

        start = awaitTermination = lambda self: self

    before = spark.conf.get(feeds.PARTITIONS)
    spark.conf.set(feeds.PARTITIONS, "200")
    try:
        feeds.drained(Writer(), rocksdb=True)
        feeds.drained(Writer())
        assert spark.conf.get(feeds.PARTITIONS) == "200"
    finally:
        spark.conf.set(feeds.PARTITIONS, before)
    assert int(seen[0][0]) <= 4 * spark.sparkContext.defaultParallelism and seen[0][1] == feeds.ROCKSDB
    assert seen[1] == ("200", None)
