"""Event feeds as Structured Streaming jobs; each has a batch twin used as its reference."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampType

MILESTONE_KEY = ("project_id", "revision_id", "flow_id", "event_type")


def first_by_seq(events: DataFrame, keys: list[str]) -> DataFrame:
    """T1/T4 in batch: the event with the least ``seq`` of each key. Combines before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    first = events.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("first"))
    return first.select(*keys, "first.*").select(*events.columns)


def _plain(value):
    """A cell of a pandas frame as a state value."""
    if value is None or value is pd.NaT or (isinstance(value, float) and pd.isna(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    return value.item() if hasattr(value, "item") else value


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


class _First(StatefulProcessor):
    """Keeps the event with the least ``seq`` of a key.

    It is told once, when the watermark has passed its key's first event, and only a mark is kept after.
    """

    def __init__(self, schema: StructType) -> None:
        self.schema = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", StructType([StructField(f.name, f.dataType, True) for f in self.schema.fields]))
        self.told = handle.getValueState("told", StructType([StructField("told", BooleanType(), True)]))

    def _row(self, values) -> pd.DataFrame:
        return pd.DataFrame([list(values)], columns=self.schema.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if self.told.exists():
            return
        best = tuple(_plain(v) for v in batch.loc[batch["seq"].idxmin(), self.schema.names])
        at = self.schema.names.index("seq")
        held = self.first.get() if self.first.exists() else None
        if held is not None and held[at] <= best[at]:
            return
        self.first.update(best)
        if held is None:
            ts = self.schema.names.index("ts")
            self.handle.registerTimer(max(_millis(best[ts]), timerValues.getCurrentWatermarkInMs()) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.first.exists():
            yield self._row(self.first.get())
            self.first.clear()
            self.told.update((True,))

    def close(self) -> None:
        pass


def _first_in_stream(events: DataFrame, keys: list[str], horizon: str | None) -> DataFrame:
    if horizon is None:
        # The time of a micro-batch is one value, kept with the event: a key is told when its first is of this batch.
        rest = [c for c in events.columns if c not in keys]
        order = F.when(F.col("seq").isNotNull(), F.struct("seq", "told_at"))
        first = events.withColumn("told_at", F.current_timestamp()).groupBy(*keys).agg(
            F.min_by(F.struct(*rest, "told_at"), order).alias("first")
        )
        return first.where(F.col("first.told_at") == F.current_timestamp()).select(*keys, "first.*").select(*events.columns)
    schema = StructType([StructField(f.name, f.dataType, True) for f in events.schema.fields])
    timed = events.withWatermark("ts", horizon)
    return timed.groupBy(*keys).transformWithStateInPandas(_First(schema), schema, "Append", "EventTime")


def first_milestones(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """The first event, by ``seq``, of every milestone; repeats change nothing, for all time.

    Batches may come out of order. Without a horizon a milestone is told at once and told again if an event
    with a lesser ``seq`` follows, so the sink keeps the last row by key (output mode update). With one, it is
    told once, when the watermark is ``horizon`` beyond it, and a key keeps one mark in the state after that.
    """
    return first_by_seq(events, list(MILESTONE_KEY)) if not events.isStreaming else _first_in_stream(events, list(MILESTONE_KEY), horizon)


def first_seen_entries(events: DataFrame, horizon: str | None = None) -> DataFrame:
    """T4: the first event, by ``seq``, of every vocabulary entry; as ``first_milestones``."""
    return first_by_seq(events, ["entry_id"]) if not events.isStreaming else _first_in_stream(events, ["entry_id"], horizon)


PAIR_SCHEMA = "session_id string, line_id string, started_at timestamp, saved_at timestamp, seconds double"


class _Pairing(StatefulProcessor):
    """Keeps the open start of one (session, line); with timers it is forgotten after some time."""

    def __init__(self, lifetime_ms: int | None) -> None:
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.start = handle.getValueState("start", StructType([StructField("ts", TimestampType(), True), StructField("seq", LongType(), True)]))

    def _forget_timers(self) -> None:
        if self.lifetime_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([r[["ts", "seq", "event_type"]] for r in rows], ignore_index=True)
        if self.start.exists():
            ts, seq = self.start.get()
            batch = pd.concat([pd.DataFrame({"ts": [pd.Timestamp(ts)], "seq": [seq], "event_type": ["started"]}), batch], ignore_index=True)
        batch = batch.sort_values(["ts", "seq"], ignore_index=True)
        before = batch.shift(1)
        paired = (batch["event_type"] == "saved") & (before["event_type"] == "started")
        last = batch.iloc[-1]
        self._forget_timers()
        if last["event_type"] == "started":
            self.start.update((_plain(last["ts"]), int(last["seq"])))
            if self.lifetime_ms is not None:
                self.handle.registerTimer(max(_millis(last["ts"]) + self.lifetime_ms, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.start.clear()
        if paired.any():
            saved, started = batch.loc[paired, "ts"], pd.to_datetime(before.loc[paired, "ts"])
            yield pd.DataFrame({
                "session_id": str(key[0]), "line_id": str(key[1]), "started_at": started, "saved_at": saved,
                "seconds": (saved - started).dt.total_seconds(),
            })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.start.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_correction_pairs(events: DataFrame, lateness: str | None = None, lifetime_seconds: int = 86_400) -> DataFrame:
    """started/saved pairs as they happen; state is one start for each open correction.

    With ``lateness`` (of the watermark) an open start is forgotten ``lifetime_seconds`` of event time after it,
    so the state follows the open corrections and not the log. A key's events are paired in the order of
    (ts, seq) within what a micro-batch and the state hold.
    """
    moves = events.filter(F.col("event_type").isin("started", "saved"))
    if lateness is not None:
        moves = moves.withWatermark("ts", lateness)
    return moves.groupBy("session_id", "line_id").transformWithStateInPandas(
        statefulProcessor=_Pairing(None if lateness is None else 1000 * lifetime_seconds), outputStructType=PAIR_SCHEMA,
        outputMode="Append", timeMode="None" if lateness is None else "EventTime",
    )


class _Entry(StatefulProcessor):
    """The state of one vocabulary id: which (action, at) were seen with the least ``seq``, and what each add held.

    All of it is one value, read and written once for an id and micro-batch.
    """

    def __init__(self, fields: StructType) -> None:
        self.fields = fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = [StructField("action", StringType(), True), StructField("at", StringType(), True), StructField("seq", LongType(), True)]
        move = StructType([*held, *[StructField(f.name, f.dataType, True) for f in self.fields.fields]])
        self.moves = handle.getValueState("moves", StructType([StructField("moves", ArrayType(move), True)]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.moves.get()
        moves = {} if held is None else {(m[0], m[1]): tuple(m) for m in held[0]}
        changed = False
        for row in rows:
            move, seq = (row["action"], row["at"]), int(row["seq"])
            if move in moves and moves[move][2] <= seq:
                continue
            changed = True
            moves[move] = (*move, seq, *[row[f] if move[0] == "add" else None for f in self.fields.names])
        if not changed:
            return
        self.moves.update((list(moves.values()),))
        adds = [m for m in moves.values() if m[0] == "add"]
        if not adds:
            return
        added, last = max(adds, key=lambda m: m[2]), max((m[2], m[0], m[1]) for m in moves.values())
        names = ["id", "version", "n_moves", "decided_at", *self.fields.names, "retired_at"]
        yield Row(**dict(zip(names, [key[0], last[0], len(moves), added[1], *added[3:], last[2] if last[1] == "retire" else None], strict=True)))

    def close(self) -> None:
        pass


def vocabulary_updates(log: DataFrame) -> DataFrame:
    """A change feed (seq, action, id, at, entry fields) as new states of the entries that it changes.

    State is kept by id, so the work of a micro-batch follows its own events, not the log. An event that comes
    again (same action, id and at) changes nothing, in whatever batch. Rows are (id, version, n_moves,
    decided_at, fields, retired_at); of an id's rows the one with the most ``n_moves`` and then the greatest
    ``version`` is current (output mode update).
    """
    fields = StructType([f for f in log.schema.fields if f.name not in ("seq", "action", "id", "at")])
    shown = StructType([
        StructField("id", StringType(), True), StructField("version", LongType(), True), StructField("n_moves", LongType(), True),
        StructField("decided_at", StringType(), True), *[StructField(f.name, f.dataType, True) for f in fields.fields],
        StructField("retired_at", StringType(), True),
    ])
    return log.groupBy("id").transformWithState(_Entry(fields), shown, "Update", "None")


def publish_updates(updates: DataFrame, path: str):
    """A stream writer that keeps updates as one table for each epoch; an epoch that runs again replaces its own."""

    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return updates.writeStream.outputMode("update").foreachBatch(publish)


def latest_entries(updates: DataFrame) -> DataFrame:
    """The current state of each id among published updates; the form of ``catalog.current_entries``."""
    rest = [c for c in updates.columns if c not in ("id", "epoch")]
    last = updates.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("n_moves", "version")).alias("e"))
    return last.select("id", "e.*")


def compact_updates(spark: SparkSession, path: str, target: str) -> None:
    """Write the current states as the only table of ``target``, for readers to go on from."""
    latest_entries(spark.read.parquet(path)).write.mode("overwrite").parquet(f"{target}/epoch=-1")
