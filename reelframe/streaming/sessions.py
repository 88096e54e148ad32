"""Stateful operators with event-time timers: live sessions, presence, latest states with tombstones that end (ST2, ST8, ST9).

State lives in the RocksDB store, so it may outgrow memory.  A key's events of one batch are one task's, whose size
the feed bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from reelframe.operators.running import SUM, running
from reelframe.streaming.state import KeyedTable

#: Sessions untouched for longer than this are closed by the next sweep, in ms; how late an event may come.
IDLE_MS, SWEEP_MS, LATE = 120_000, 60_000, "10 minutes"


class InOrder(StatefulProcessor):
    """Keeps a key's events until the watermark has passed them, then applies them in order of (at, seq).

    A timer wakes the key at its first kept event and when :meth:`wake` says.  ``EVENT`` and ``STATE`` are the fields of
    what is kept; every event starts with ``at`` (ms) and ``seq``.
    """

    EVENT, STATE = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", self.EVENT)
        self.state = handle.getValueState("state", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in self.EVENT.split(", ")]
        events = [tuple(r[n] for n in names) for r in rows]
        self.kept.appendList(events)
        self.handle.registerTimer(min(e[0] for e in events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        kept = [tuple(e) for e in self.kept.get()]
        ripe = sorted((e for e in kept if e[0] <= now), key=lambda e: e[:2])
        state = tuple(self.state.get()) if self.state.exists() else None
        found, state = self.apply(key[0], state, ripe, now)
        later = [e for e in kept if e[0] > now]
        if ripe:
            self.kept.put(later) if later else self.kept.clear()
        self.state.update(state) if state is not None else self.state.clear()
        wakes = [e[0] for e in later] + ([self.wake(state)] if state is not None and self.wake(state) else [])
        if wakes:
            self.handle.registerTimer(min(wakes))
        yield from found

    def apply(self, key, state: tuple | None, events: list[tuple], now: int) -> tuple[list[Row], tuple | None]:
        raise NotImplementedError

    def wake(self, state: tuple) -> int | None:
        return None

    def close(self) -> None:
        pass


def sweep_after(last: int) -> int:
    """The first sweep by which a session last touched at ``last`` has been idle for longer than ``IDLE_MS``."""
    return ((last + IDLE_MS) // SWEEP_MS + 1) * SWEEP_MS


class Sessions(InOrder):
    """ST9: +1 when a session opens, -1 when a stop or a sweep closes it; state: when it was last touched."""

    EVENT, STATE = "at long, seq long, stop boolean", "last long"

    def apply(self, key, state, events, now):
        found, last = [], state[0] if state else None
        step = lambda at, n: found.append(Row(key=key, moment=at, step=n))
        for at, _, stop in events:
            if last is not None and sweep_after(last) <= at:
                step(sweep_after(last), -1)
                last = None
            if stop:
                if last is not None:
                    step(at, -1)
                last = None
            else:
                if last is None:
                    step(at, 1)
                last = at
        if last is not None and sweep_after(last) <= now:
            step(sweep_after(last), -1)
            last = None
        return found, None if last is None else (last,)

    def wake(self, state):
        return sweep_after(state[0])


class Presence(InOrder):
    """ST8: each change of the roster, stamped with the connection's own id whatever the message claims."""

    EVENT, STATE = "at long, seq long, kind string, width long", "width long"

    def apply(self, key, state, events, now):
        found = []
        for at, seq, kind, width in events:
            if kind == "removed":
                if state is None:
                    continue
                found.append(Row(client_id=key, moment=at, seq=seq, change="left", width=state[0], step=-1))
                state = None
            else:
                found.append(Row(client_id=key, moment=at, seq=seq, change="updated" if state else "joined", width=width, step=0 if state else 1))
                state = (width,)
        return found, state


class Latest(StatefulProcessor):
    """ST1, ST2: the newest event of a key, with the last known value of some fields; a removal is a tombstone.

    Once the watermark has passed a tombstone, no older event can come: its timer ends it, and the key has no state any
    more.  A key that is ended is told with the kind ``ended``.
    """

    def __init__(self, key: str, fields: list[str], keep: list[str], state: StructType) -> None:
        self.key, self.fields, self.keep, self.schema = key, fields, keep, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = self.schema.names
        state = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names)
        before = state["at"], state["seq"]
        for r in rows:
            order = (r["at"], r["seq"])
            if state["at"] is None or order > (state["at"], state["seq"]):
                state |= {c: r[c] for c in ("at", "seq", *self.fields)}
            for c in self.keep:
                if r[c] is not None and (state[f"at_{c}"] is None or order > (state[f"at_{c}"], state[f"seq_{c}"])):
                    state |= {c: r[c], f"at_{c}": order[0], f"seq_{c}": order[1]}
        self.state.update(tuple(state[c] for c in names))
        if state["kind"] == "removed" and before != (state["at"], state["seq"]):
            self.handle.registerTimer(state["at"] // 1000)
        yield self.row(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        state = dict(zip(self.schema.names, self.state.get(), strict=True))
        if state["kind"] == "removed" and state["at"] // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self.row(key, state | {"kind": "ended"})

    def row(self, key, state: dict) -> Row:
        return Row(**{self.key: key[0]}, **{c: state[c] for c in ("at", "seq", *self.fields, *self.keep)})

    def close(self) -> None:
        pass


def latest_with_ends(stream: DataFrame, key: str, keep: list[str], late: str = LATE) -> DataFrame:
    """A stream of the newest state of keys (``at`` in microseconds); ``stream`` has event_ts, seq, kind and other fields."""
    rows = stream.withWatermark("event_ts", late).withColumn("at", F.unix_micros("event_ts"))
    fields = [c for c in stream.columns if c not in (key, "event_ts", "seq", *keep)]
    long = lambda name: StructField(name, LongType())
    own = [long("at"), long("seq"), *[StructField(c, stream.schema[c].dataType) for c in (*fields, *keep)]]
    state = StructType([*own, *[long(f"{what}_{c}") for c in keep for what in ("at", "seq")]])
    out = StructType([StructField(key, stream.schema[key].dataType), *own])
    return rows.groupBy(key).transformWithState(Latest(key, fields, keep, state), out, "update", "eventTime")


def fold_writer(stream: DataFrame, key: str, keep: list[str], root: str, made: list[KeyedTable], late: str = LATE) -> DataStreamWriter:
    """ST2: a query that keeps the table of latest states; tombstones end in state and table once the watermark has passed them.

    The table is added to ``made``.  It has the last state of removed keys, of kind ``removed`` or ``ended``, until a snapshot.
    """
    table = KeyedTable(stream.sparkSession, f"{root}/table", key, dead="kind = 'ended'")

    def write(batch: DataFrame, number: int) -> None:
        # A key may change and end in one batch.
        order = F.struct("at", "seq", (F.col("kind") == "ended").alias("ended"))
        table.put(batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("r")).select(key, "r.*"), number)

    made.append(table)
    return latest_with_ends(stream, key, keep, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")


def live_steps(stream: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """ST9: (key, moment in ms, step) of a stream with event_ts, seq and ``stop``."""
    rows = stream.withWatermark("event_ts", late).withColumn("at", F.unix_millis("event_ts"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.select(key, "event_ts", "at", "seq", "stop").groupBy(key).transformWithState(Sessions(), f"key {kind}, moment long, step long", "append", "eventTime")


def presence_changes(stream: DataFrame, key: str, late: str = LATE) -> DataFrame:
    """ST8: the changes of the roster of a stream with event_ts, seq, kind and width."""
    rows = stream.withWatermark("event_ts", late).withColumn("at", F.unix_millis("event_ts"))
    kind = stream.schema[key].dataType.simpleString()
    out = f"client_id {kind}, moment long, seq long, change string, width long, step long"
    return rows.select(key, "event_ts", "at", "seq", "kind", "width").groupBy(key).transformWithState(Presence(), out, "append", "eventTime")


def counted(stream: DataFrame, order: list[str], totals: dict[str, str], root: str, merge: bool = False) -> DataStreamWriter:
    """A query that writes each batch with running totals, which go on from batch to batch, to ``root``/rows.

    Batches come in order, so a batch is summed by ranges and starts from the totals of the one before; a batch
    that is run again starts from the same.  ``merge`` puts rows of one place in the order together first.
    """
    spark = stream.sparkSession
    known = KeyedTable(spark, f"{root}/totals", "id")

    def write(batch: DataFrame, number: int) -> None:
        before = known.rows(number - 1)
        base = before.first().asDict() if before is not None else {}
        rows = batch.groupBy(*order).agg(*[F.sum(c).alias(c) for c in dict.fromkeys(totals.values())]) if merge else batch
        found = running(rows, [], order, totals, SUM)
        found = found.withColumns({name: F.col(name) + F.lit(base.get(name, 0)) for name in totals})
        found.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name) for name, c in totals.items()])
        known.put(sums.select(F.lit(0).alias("id"), *[(F.col(name) + F.lit(base.get(name, 0))).alias(name) for name in totals]), number)

    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")


def roster_after(changes: DataFrame, number: int) -> DataFrame:
    """ST8: who is present after change ``number``: the last change of each client so far, unless it left."""
    last = changes.where(F.col("number") <= number).groupBy("client_id").agg(F.max_by(F.struct("change", "seq", "width"), "number").alias("r"))
    return last.where("r.change <> 'left'").select("client_id", "r.seq", "r.width")
