"""Streaming lifecycle, observations, first-seen and stage events."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleanery import defaults as d
from gleanery.operators.snapshots import advance_lifecycle, merge_observations, retain
from gleanery.scale import keep_first


def _version(root: str, batch: int) -> str:
    return f"{root}/v{batch:08d}"


def _state(spark: SparkSession, root: str, batch: int, empty: DataFrame) -> DataFrame:
    """State written by the batch before; a retried batch reads the same folder again, so it repeats its result."""

    return spark.read.schema(empty.schema).parquet(_version(root, batch - 1)) if batch > 0 else empty


def lifecycle_stream(snapshots: DataFrame, root: str, columns: list[str], stamp: str = "last_verified_at", days: int = 90) -> DataStreamWriter:
    """Lifecycle table advanced by each snapshot.

    A micro-batch is one snapshot: posting rows plus, per source, ``complete`` and ``quarantined``. Every batch writes a
    new version folder under ``root``; the job can stop anywhere and go on from its checkpoint.
    """

    def advance(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sources = batch.groupBy("source_id").agg(F.bool_and("complete").alias("complete"), F.bool_or("quarantined").alias("quarantined"))
            rows = batch.filter("id is not null").select(*columns)
            current = keep_first(rows, ["source_id", "id"], [F.col(stamp).desc(), F.col("content_hash").asc()])
            empty = batch.sparkSession.createDataFrame([], current.schema)
            previous = _state(batch.sparkSession, root, number, empty)
            now = F.lit(batch.agg(F.max("run_at")).first()[0]).cast("timestamp")
            out = retain(advance_lifecycle(previous, current, sources, now), now, days)
            out.write.mode("overwrite").parquet(_version(root, number))
        finally:
            batch.unpersist()

    return snapshots.writeStream.foreachBatch(advance)


def observation_merge_stream(observed: DataFrame, root: str, previous_schema, stale_after: int = 3) -> DataStreamWriter:
    """Entry state merged per probe batch (T2); one observation per company and batch is kept, the newest."""

    def merge(batch: DataFrame, number: int) -> None:
        empty = batch.sparkSession.createDataFrame([], previous_schema)
        newest = keep_first(batch, ["company_id"], [F.col("checked_at").desc()])
        merge_observations(_state(batch.sparkSession, root, number, empty), newest, stale_after).write.mode("overwrite").parquet(_version(root, number))

    return observed.writeStream.foreachBatch(merge)


OBSERVATION_OUT = "company_id string, checked_at timestamp, directory_status string, consecutive_failures int, first_confirmed_at timestamp"
OBSERVATION_STATE = "directory_status string, consecutive_failures int, first_confirmed_at timestamp"


def observation_stream(observed: DataFrame, stale_after: int = 3) -> DataFrame:
    """Entry status per company as keyed state (T2): failures count up, a confirmation resets them.

    The state of a company is three values, however many observations arrive.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, failures, first = state.get if state.exists else (None, 0, None)
        out = []
        # one key's rows of one micro-batch, whose size the trigger bounds
        for seen in pd.concat(list(batches)).sort_values("checked_at").itertuples(index=False):
            if seen.directory_status == "ACTIVE_CONFIRMED":
                status, failures, first = "ACTIVE_CONFIRMED", 0, first or seen.checked_at.to_pydatetime()
            else:
                failures += 1
                lost = seen.directory_status in ("BLOCKED", "STALE") and status is not None
                status = ("STALE" if failures < stale_after else "INACTIVE") if lost else seen.directory_status
            out.append((key[0], seen.checked_at, status, failures, first))
        state.update((status, failures, first))
        yield pd.DataFrame(out, columns=["company_id", "checked_at", "directory_status", "consecutive_failures", "first_confirmed_at"])

    return observed.groupBy("company_id").applyInPandasWithState(step, OBSERVATION_OUT, OBSERVATION_STATE, "append", GroupStateTimeout.NoTimeout)


def first_seen_stream(rows: DataFrame, keys: list[str], stamp: str, delay: str = "7 days") -> DataFrame:
    """Rows of an at-least-once feed, each key once within the watermark."""

    return rows.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)


STAGE_OUT = "user_id string, job_id string, ts timestamp, stage string, previous_stage string, event_type string"


def stage_event_stream(log: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """Typed events on stage changes per user and job (T9). State is one stage; it may expire after ``ttl_days`` idle."""

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_days else GroupStateTimeout.NoTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["user_id", "job_id", "ts", "stage", "previous_stage", "event_type"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        before, out = (state.get[0] if state.exists else None), []
        for row in pd.concat(list(batches)).sort_values("ts").itertuples(index=False):
            if row.stage != before and row.stage in d.STAGE_EVENTS:
                out.append((key[0], key[1], row.ts, row.stage, before, d.STAGE_EVENTS[row.stage]))
            before = row.stage
        state.update((before,))
        if ttl_days:
            state.setTimeoutDuration(int(timedelta(days=ttl_days).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=columns)

    return log.groupBy("user_id", "job_id").applyInPandasWithState(step, STAGE_OUT, "stage string", "append", timeout)


# --- lifecycle as keyed state ----------------------------------------------------------------------------

LIFECYCLE_ROW = ("source_id string, id string, content_hash string, status string, first_missing_successes int, first_seen_at timestamp, last_verified_at timestamp, changed_at timestamp")
STAMPS = ("first_seen_at", "last_verified_at", "changed_at")
HELD = ("content_hash", "status", "first_missing_successes", "first_seen_at", "last_verified_at", "changed_at")
_HELD = "content_hash string, status string, first_missing_successes int, first_seen_at long, last_verified_at long, changed_at long"  # times in microseconds
_CHANGES = f"source_id string, id string, {_HELD}, run long, removed boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class PostingLifecycle(StatefulProcessor):
    """Postings of one shard of a source. A snapshot's rows wait until its end event arrives, in whatever micro-batch that is."""

    def __init__(self, close_after: int, days: int) -> None:
        self.close_after, self.keep_for = close_after, days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.postings = handle.getMapState("postings", "id string", _HELD)
        self.waiting = handle.getMapState("waiting", "run long, id string", _HELD)
        self.source = handle.getValueState("source", "run long, known boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done, known = self.source.get() if self.source.exists() else (None, False)
        ends: dict[int, Row] = {}  # one per snapshot of the source
        for row in rows:
            if done is not None and row["run"] <= done:
                continue  # late: its snapshot has ended
            if row["id"] is None:
                ends[row["run"]] = row
                continue
            at, new = (row["run"], row["id"]), tuple(row[c] for c in HELD)
            old = self.waiting.getValue(at) if self.waiting.containsKey(at) else None
            if old is None or (new[4], _down(old[0])) > (old[4], _down(new[0])):
                self.waiting.updateValue(at, new)
        for run in sorted(ends):
            for name, value, removed in self._advance(ends[run], known):
                yield Row(source_id=key[0], id=name, **dict(zip(HELD, value)), run=run, removed=removed)
            known = known or ends[run]["postings"] > 0
            self.source.update((run, known))

    def _advance(self, end: Row, known: bool) -> list[tuple[str, tuple, bool]]:
        """Changes of one ended snapshot, written to the state; they are those of this shard's postings."""
        run, now, trusted = end["run"], end["at"], end["complete"] and not end["quarantined"]
        new, over = {}, []
        for at, value in self.waiting.iterator():
            if at[0] <= run:
                over.append(tuple(at))
                if at[0] == run:
                    new[at[1]] = tuple(value)
        changes: dict[str, tuple] = {}
        if trusted:
            for name, held in ((k[0], tuple(v)) for k, v in self.postings.iterator()):
                if name in new:
                    fresh = new.pop(name)
                    changes[name] = (fresh[0], fresh[1], 0, held[3], fresh[4], now if fresh[0] != held[0] else held[5])
                else:
                    misses = held[2] + 1
                    changes[name] = (held[0], "CLOSED" if misses >= self.close_after else held[1], misses, *held[3:])
        if trusted or not known:
            changes |= new
        for at in over:
            self.waiting.removeKey(at)
        out = []
        for name, value in changes.items():
            if self._expired(value, now):
                self.postings.removeKey((name,))
                out.append((name, value, True))
            else:
                self.postings.updateValue((name,), value)
                out.append((name, value, False))
                if value[1] == "CLOSED":
                    self.handle.registerTimer((value[4] + self.keep_for) // 1000 + 1)
        return out

    def _expired(self, value: tuple, now: int) -> bool:
        return value[1] == "CLOSED" and value[4] is not None and value[4] < now - self.keep_for

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Closed postings of sources that went quiet leave when the watermark passes their time."""
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        run = self.source.get()[0]
        for name, value in [(k[0], tuple(v)) for k, v in self.postings.iterator() if self._expired(tuple(v), now)]:
            self.postings.removeKey((name,))
            yield Row(source_id=key[0], id=name, **dict(zip(HELD, value)), run=run, removed=True)


class _down(str):
    """A text that orders the other way round."""

    def __lt__(self, other):
        return str.__gt__(self, other)

    def __gt__(self, other):
        return str.__lt__(self, other)


def keyed_lifecycle(events: DataFrame, shards: int = 16, close_after: int = 2, days: int = 90, delay: str = "0 seconds") -> DataFrame:
    """Changes of the lifecycle table as snapshots end (T1, T5): state is kept per posting, and only postings of ended snapshots are touched.

    ``events``: the columns of a posting with ``run`` (rising per source) and ``run_at``, and for each (source, run) an end event without
    an id that says ``complete``, ``quarantined`` and how many ``postings`` the snapshot holds. Postings of a source are dealt to
    ``shards`` keys by their id, so a large source is no single task; end events go to all of them. Rows of a run that has ended are late
    and ignored. Needs the RocksDB state store. A source counts as known from its first snapshot with postings that was taken over.
    """

    shard = F.when(F.col("id").isNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")))
    rows = events.withWatermark("run_at", delay).withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in STAMPS} | {"at": F.unix_micros("run_at"), "shard": F.explode(shard)})
    changes = rows.groupBy("source_id", "shard").transformWithState(
        statefulProcessor=PostingLifecycle(close_after, days), outputStructType=_CHANGES, outputMode="Append", timeMode="EventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in STAMPS})


def latest_lifecycle(changes: DataFrame) -> DataFrame:
    """The table that the changes add up to."""

    newest = keep_first(changes, ["source_id", "id"], [F.col("run").desc(), F.col("removed").desc()])
    return newest.filter(~F.col("removed")).drop("run", "removed")
