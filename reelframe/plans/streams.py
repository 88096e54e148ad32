"""Streaming queries over the events table; each drains what is there and returns its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.operators import timeline as T
from reelframe.plans.registry import query
from reelframe.sources.carriers import carrier, given, with_carriers as sql
from reelframe.sources.workspace import shared_path
from reelframe.streaming import folds as S, sessions as N
from reelframe.streaming.feeds import OrderedEvents, event_stream


def _ordered(spark, sf_dir, *columns):
    return OrderedEvents(spark, f"{sf_dir}/events.parquet", list(columns))


def _progress(rows):
    """Events as progress, status and removal events of ``user_id``; a status event says nothing of the bytes."""
    total = F.when(F.col("seq") % 3 == 0, F.col("user_id") * 10)
    kind = F.when((F.col("seq") % 29 == 0) & (F.col("user_id") % 2 == 0), "removed").otherwise(F.col("event_type"))
    return rows.select(F.col("user_id").alias("id"), "event_ts", "seq", kind.alias("kind"), F.when(F.col("event_type") != "error", F.floor("value")).alias("done"), total.alias("total"), (F.col("seq") % 4 != 0).alias("finished"))


_PROGRESS = "(SELECT user_id AS id, ts AS event_ts, event_id AS seq, CASE WHEN event_id % 29 = 0 AND user_id % 2 = 0 THEN 'removed' ELSE event_type END AS kind, CASE WHEN event_type <> 'error' THEN floor(value)::bigint END AS done, CASE WHEN event_id % 3 = 0 THEN user_id * 10 END AS total, event_id % 4 <> 0 AS finished FROM events)"
_DONE = "arg_max(done, (event_ts, seq)) FILTER (WHERE done IS NOT NULL) AS done"


@query(
    "stream_latest",
    f"WITH s AS (SELECT id, max(seq) AS seq, arg_max(kind, (event_ts, seq)) AS kind, {_DONE}, arg_max(total, (event_ts, seq)) FILTER (WHERE total IS NOT NULL) AS total FROM {_PROGRESS} GROUP BY id) SELECT * FROM s WHERE kind <> 'removed'",
)
def stream_latest(spark, sf_dir):
    return S.fold_latest(_progress(event_stream(spark, f"{sf_dir}/events.parquet")), "id", ["done", "total"]).select("id", "seq", "kind", "done", "total")


@query("stream_complete_once", f"SELECT DISTINCT id FROM {_PROGRESS} WHERE finished AND total > 0 AND done >= total")
def stream_complete_once(spark, sf_dir):
    """The watermark lets a key come again after its delay; the table keeps one row of each."""
    return S.feed_to_table(_ordered(spark, sf_dir, "user_id", "event_type", "value"), lambda rows: S.completed_once(_progress(rows), "id")).select("id").distinct()


@query(
    "stream_idle_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 120 SECOND THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e),
    g AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 120 SECOND AS ended, count(*) AS n FROM s GROUP BY user_id, k)
    SELECT user_id, epoch_us(started) AS started, epoch_us(ended) AS ended, n FROM g WHERE ended <= (SELECT max(ts) FROM events) - INTERVAL 600 SECOND""",
)
def stream_idle_sessions(spark, sf_dir):
    closed = S.feed_to_table(_ordered(spark, sf_dir, "user_id"), lambda rows: S.idle_sessions(rows, "user_id"))
    return closed.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"), "n")


@query("stream_ticks", "WITH w AS (SELECT user_id, floor(epoch_us(ts) / 2000000)::bigint * 2000000 AS started, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) SELECT user_id, started, count(*) AS n, max(value) AS value FROM w WHERE started + 2000000 <= (SELECT max(epoch_us(ts)) FROM events WHERE user_id IN (SELECT c_custkey FROM customer)) - 600000000 GROUP BY ALL")
def stream_ticks(spark, sf_dir):
    wanted = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).distinct()
    found = S.feed_to_table(_ordered(spark, sf_dir, "user_id", "value"), lambda rows: S.ticks(rows, wanted))
    return found.withColumn("started", F.unix_micros("started"))


@query(
    "stream_stats",
    """WITH w AS (SELECT user_id AS info_hash, floor(epoch_us(ts) / 2000000)::bigint * 2000000 AS started, ts, event_id AS seq, floor(value)::bigint AS progress, user_id * 10 AS total, floor(value * 2)::bigint AS speed, event_id % 50 AS peers, value >= user_id * 10 AS finished FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
    l AS (SELECT info_hash, started, arg_max(struct_pack(progress, total, speed, peers, finished), (ts, seq)) AS r FROM w GROUP BY ALL)
    SELECT info_hash, started, r.progress AS progress, r.total AS total, r.speed AS speed, r.peers AS peers, r.finished AS finished FROM l WHERE started + 2000000 <= (SELECT max(epoch_us(ts)) FROM w) - 600000000""",
)
def stream_stats(spark, sf_dir):
    """ST6: the last stats of wanted releases per two seconds."""
    wanted = given(spark, sf_dir, "customer").select(F.col("c_custkey").alias("info_hash")).distinct()
    u, v = F.col("user_id"), F.col("value")
    shaped = lambda rows: rows.select(u.alias("info_hash"), "event_ts", "seq", F.floor(v).alias("progress"), (u * 10).alias("total"), F.floor(v * 2).alias("speed"), (F.col("seq") % 50).alias("peers"), (v >= u * 10).alias("finished"))
    found = S.feed_to_table(_ordered(spark, sf_dir, "user_id", "value"), lambda rows: S.stats(shaped(rows), wanted, ["progress", "total", "speed", "peers", "finished"]))
    return found.withColumn("started", F.unix_micros("started"))


@query("stream_waiting", f"WITH s AS (SELECT id, {_DONE}, arg_max(kind, (event_ts, seq)) AS kind FROM {_PROGRESS} GROUP BY id) SELECT id, done, coalesce(done, 0) <= 0 AS waiting FROM s WHERE kind <> 'removed'")
def stream_waiting(spark, sf_dir):
    return S.waiting(S.fold_latest(_progress(event_stream(spark, f"{sf_dir}/events.parquet")), "id", ["done", "total"])).select("id", "done", "waiting")


@query(
    "stream_route",
    """SELECT 'remote_' || event_type AS topic, event_id AS seq, user_id AS sender, (props::json->>'$.k')::int AS k, CASE WHEN event_id % 3 = 0 THEN 'play' END AS action FROM events WHERE event_id % 2 = 0""",
)
def stream_route(spark, sf_dir):
    """ST11, SC12: messages of remote topics with their whole payload, whose nested fields are read from what was stored."""
    rows = event_stream(spark, f"{sf_dir}/events.parquet")
    action = F.when(F.col("seq") % 3 == 0, F.lit(',"command":{"action":"play","at":[1,2]}')).otherwise("")
    payload = F.concat(F.lit('{"from":'), F.col("user_id"), F.lit(',"body":'), "props", action, F.lit("}"))
    topic = F.concat(F.when(F.col("seq") % 2 == 0, "remote_").otherwise("local_"), "event_type")
    sent = S.route(rows.select(topic.alias("topic"), "seq", payload.alias("payload")), "remote_")
    of = lambda path, kind: F.try_variant_get("payload", path, kind)
    return sent.select("topic", "seq", of("$.from", "long").alias("sender"), of("$.body.k", "int").alias("k"), of("$.command.action", "string").alias("action"))


@query(
    "stream_failure_alarm",
    """WITH e AS (SELECT user_id AS key, event_id AS seq, ts, event_type IN ('error', 'click') AS failed FROM events), i AS (SELECT *, sum((NOT failed)::int) OVER (PARTITION BY key ORDER BY ts, seq) AS island FROM e),
    n AS (SELECT key, seq, row_number() OVER (PARTITION BY key, island ORDER BY ts, seq) AS n FROM i WHERE failed) SELECT key, seq FROM n WHERE n = 3""",
)
def stream_failure_alarm(spark, sf_dir):
    made = lambda rows: rows.select(F.col("user_id").alias("key"), "event_ts", "seq", F.col("event_type").isin("error", "click").alias("failed"))
    return S.failure_alarm(_ordered(spark, sf_dir, "user_id", "event_type"), made, 3)


@query(
    "stream_heartbeats",
    "WITH h AS (SELECT user_id, arg_max(struct_pack(event_id, position := floor(value * 10)::bigint), (ts, event_id)) AS r FROM events WHERE value > 0 GROUP BY user_id) SELECT user_id AS media_id, r.event_id AS seq, r.position AS position FROM h",
)
def stream_heartbeats(spark, sf_dir):
    """ST10: heartbeats into the newest position of each title."""
    rows = event_stream(spark, f"{sf_dir}/events.parquet").where("value > 0")
    rows = rows.select(F.col("user_id").alias("media_id"), "event_ts", "seq", F.lit("heartbeat").alias("kind"), F.floor(F.col("value") * 10).alias("position"))
    return S.fold_latest(rows, "media_id", [], "watch").select("media_id", "seq", "position")


@query(
    "stream_piece_ticks",
    "WITH n AS (SELECT user_id AS file_id, event_id AS piece, event_type = 'view' AS have, max(event_id) OVER (PARTITION BY user_id) + 1 AS n FROM events) SELECT file_id, (((piece + 1) * least(200, n) - 1) // n)::bigint AS bucket, (sum(have::bigint) * 255 // count(*))::bigint AS level FROM n GROUP BY ALL",
)
def stream_piece_ticks(spark, sf_dir):
    """ST12: the availability of pieces after the stream's last batch."""
    stream = event_stream(spark, f"{sf_dir}/events.parquet")
    rows = stream.select(F.concat_ws("/", "user_id", "seq").alias("id"), "event_ts", "seq", F.lit("piece").alias("kind"), F.col("user_id").alias("file_id"), (F.col("event_type") == "view").alias("have"))
    state = S.fold_latest(rows, "id", [], "pieces")
    return T.piece_buckets(state.select("file_id", F.col("seq").alias("piece"), "have"))


_KIND = "CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' THEN 'register' ELSE 'update' END"


def _connections(rows):
    """Registrations, updates and disconnections of connections; what a message claims as its id isn't taken."""
    return rows.select((F.col("user_id") % 40).alias("client_id"), "event_ts", "seq", F.expr(_KIND).alias("kind"), (F.floor("value") * 4).alias("width"))


@query(
    "roster",
    f"""WITH e AS (SELECT user_id % 40 AS client_id, ts, event_id AS seq, {_KIND} AS kind, floor(value)::bigint * 4 AS width FROM events),
    s AS (SELECT client_id, arg_max(seq, (ts, seq)) AS seq, arg_max(kind, (ts, seq)) AS kind, arg_max(width, (ts, seq)) AS width FROM e GROUP BY client_id)
    SELECT client_id, seq, width, CASE WHEN width < 768 THEN 'phone' WHEN width < 1024 THEN 'tablet' ELSE 'desktop' END AS device FROM s WHERE kind <> 'removed'""",
)
def roster(spark, sf_dir):
    """ST8, ST2: who is present, by the stateful operator; tombstones of those who left end with the watermark."""
    from reelframe.functions.labels import device_kind

    root, last = shared_path(spark, "roster"), []
    _ordered(spark, sf_dir, "user_id", "event_type", "value").feed(lambda rows: N.fold_writer(_connections(rows), "client_id", [], root, last), rocksdb=True)
    return last[-1].rows().where("kind NOT IN ('removed', 'ended')").select("client_id", "seq", "width", device_kind(F.col("width")).alias("device"))


_CHANGES = f"""e AS (SELECT user_id % 40 AS client_id, epoch_us(ts) // 1000 AS moment, event_id AS seq, {_KIND} AS kind, floor(value)::bigint * 4 AS width FROM events),
    c AS (SELECT *, lag(kind) OVER w AS before, lag(width) OVER w AS last_width FROM e WINDOW w AS (PARTITION BY client_id ORDER BY moment, seq)),
    d AS (SELECT client_id, moment, seq, CASE WHEN kind = 'removed' THEN 'left' WHEN before IS NULL OR before = 'removed' THEN 'joined' ELSE 'updated' END AS change, CASE WHEN kind = 'removed' THEN last_width ELSE width END AS width
      FROM c WHERE (kind <> 'removed' OR before <> 'removed') AND moment <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000),
    n AS (SELECT *, row_number() OVER (ORDER BY moment, seq) AS number, sum(CASE change WHEN 'joined' THEN 1 WHEN 'left' THEN -1 ELSE 0 END) OVER (ORDER BY moment, seq)::bigint AS n_present FROM d)"""


def _roster_changes(spark, sf_dir):
    root = shared_path(spark, "presence")
    made = lambda rows: N.counted(N.presence_changes(_connections(rows), "client_id").withColumn("one", F.lit(1).cast("long")), ["moment", "seq"], {"n_present": "step", "number": "one"}, root)
    _ordered(spark, sf_dir, "user_id", "event_type", "value").feed(made, rocksdb=True)
    return spark.read.parquet(f"{root}/rows").select("client_id", "moment", "seq", "change", "width", "number", "n_present")


@query("roster_changes", f"WITH {_CHANGES} SELECT * FROM n")
def roster_changes(spark, sf_dir):
    """ST8: every change of the roster with its number, stamped with the connection's id, and how many are present after it."""
    return _roster_changes(spark, sf_dir)


@query(
    "roster_after",
    f"""WITH {_CHANGES}, l AS (SELECT client_id, arg_max(struct_pack(change, seq, width), number) AS r FROM n WHERE number <= 100 GROUP BY client_id) SELECT client_id, r.seq AS seq, r.width AS width FROM l WHERE r.change <> 'left'""",
)
def roster_after(spark, sf_dir):
    """ST8: the whole roster as it was sent after the hundredth change."""
    return N.roster_after(_roster_changes(spark, sf_dir), 100)


@query(
    "stream_live_counts",
    """WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS touched, event_id AS seq, event_type = 'signup' AS stop FROM events),
    p AS (SELECT *, lag(touched) OVER w AS last, lag(stop) OVER w AS stopped FROM e WINDOW w AS (PARTITION BY user_id ORDER BY touched, seq)),
    q AS (SELECT *, ((last + 120000) // 60000 + 1) * 60000 AS sweep, lead(touched) OVER (PARTITION BY user_id ORDER BY touched, seq) AS next, ((touched + 120000) // 60000 + 1) * 60000 AS swept FROM p),
    c AS (
      SELECT touched AS moment, 1 AS step FROM q WHERE NOT stop AND (last IS NULL OR stopped OR sweep <= touched)
      UNION ALL SELECT touched, -1 FROM q WHERE stop AND last IS NOT NULL AND NOT stopped AND sweep > touched
      UNION ALL SELECT swept, -1 FROM q WHERE NOT stop AND (next IS NULL OR next >= swept)
    ), t AS (SELECT moment, sum(step) AS step FROM c WHERE moment <= (SELECT max(epoch_us(ts) // 1000) FROM events) - 600000 GROUP BY moment)
    SELECT moment::bigint AS moment, sum(step) OVER (ORDER BY moment)::bigint AS n_live FROM t""",
)
def stream_live_counts(spark, sf_dir):
    """ST9: how many sessions live after each moment at which some open, stop or are swept, a sweep a minute."""
    root = shared_path(spark, "live")
    shaped = lambda rows: rows.select("user_id", "event_ts", "seq", (F.col("event_type") == "signup").alias("stop"))
    made = lambda rows: N.counted(N.live_steps(shaped(rows), "user_id"), ["moment"], {"n_live": "step"}, root, merge=True)
    _ordered(spark, sf_dir, "user_id", "event_type").feed(made, rocksdb=True)
    return spark.read.parquet(f"{root}/rows").select("moment", "n_live")


@query("stream_known", sql(f"WITH s AS (SELECT id, {_DONE}, arg_max(kind, (event_ts, seq)) AS kind FROM {_PROGRESS} GROUP BY id) SELECT s.id, s.done, d.name, d.total_bytes FROM s JOIN {{downloads}} d ON d.id = s.id WHERE kind <> 'removed'"))
def stream_known(spark, sf_dir):
    """ST1: progress onto the table of downloads, which every batch reads anew."""
    snapshot = lambda: carrier(spark, sf_dir, "downloads").select("id", "name", "total_bytes")
    return S.fold_latest(_progress(event_stream(spark, f"{sf_dir}/events.parquet")), "id", ["done", "total"], snapshot=snapshot).select("id", "done", "name", "total_bytes")
