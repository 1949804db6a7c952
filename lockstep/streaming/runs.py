"""Stateful streams with event-time timers: runs that fall silent, and calls that outlive their retention.

Both keep their state by key in the state store and wake by timers, so that an expiry comes when the watermark passes it and
not when the key is next heard of. They need the RocksDB state store, which is set for the session when a stream is planned.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

IDLE_MINUTES = 120
LATE = "1 hour"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(time: datetime) -> int:
    return round(time.timestamp() * 1000) if time.tzinfo else round(time.replace(tzinfo=UTC).timestamp() * 1000)


class IdleRuns(StatefulProcessor):
    """State: the last heartbeat of a run that is live. A silence of more than idle_ms ends it, in the middle of a batch too."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, beats long")

    def _ended(self, key, at: int, beats: int) -> Row:
        return Row(id=key[0], last_ms=at, beats=beats)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The heartbeats of one run in one batch, which the source's options bound, in the order of time."""
        known = self.last.get() if self.last.exists() else None
        at, beats = (known[0], known[1]) if known else (None, 0)
        if known:
            self.handle.deleteTimer(at + self.idle_ms)
        for time in sorted(row.at_ms for row in rows):
            if at is not None and time - at > self.idle_ms:
                yield self._ended(key, at, beats)
                beats = 0
            at, beats = time if at is None else max(at, time), beats + 1
        self.last.update((at, beats))
        self.handle.registerTimer(at + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            at, beats = self.last.get()
            if at + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._ended(key, at, beats)

    def close(self) -> None:
        pass


class Retention(StatefulProcessor):
    """State: the calls of a key that are kept, by day of their end; a timer for each day's last moment drops them together."""

    SLOT_MS = 86_400_000

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "slot long", "ids array<long>")

    def _slot(self, at: int) -> int:
        """The first end of a slot at which a call of this time is out of its retention."""
        return -(-(at + self.keep_ms) // self.SLOT_MS) * self.SLOT_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added: dict[int, list[int]] = {}
        for row in rows:
            added.setdefault(self._slot(row.at_ms), []).append(row.id)
        for slot, ids in added.items():
            if self.kept.containsKey((slot,)):
                ids = [*self.kept.getValue((slot,))[0], *ids]
            else:
                self.handle.registerTimer(slot)
            self.kept.updateValue((slot,), (ids,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        slot = expiredTimerInfo.getExpiryTimeInMs()
        if self.kept.containsKey((slot,)):
            ids = self.kept.getValue((slot,))[0]
            self.kept.removeKey((slot,))
            for one in ids:
                yield Row(id=one, expired_ms=slot)

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, key: str, late: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return rows.selectExpr("*", "unix_millis(at) as at_ms").withWatermark("at", late).groupBy(key)


def idle_runs(beats: DataFrame, key: str = "id", minutes: int = IDLE_MINUTES, late: str = LATE) -> DataFrame:
    """(id, last_ms, beats) of each run of the stream beats (key, at) that was silent for more than minutes.

    A run that is heard of again begins anew. The watermark, at which silences end, is late behind the newest heartbeat; one
    that comes later still counts for its run while that is live. Null keys are a run of their own, null times are dropped.
    """
    rows = beats.where("at is not null").selectExpr(f"cast({key} as string) as run", "at")
    return _timed(rows, "run", late).transformWithState(IdleRuns(minutes * 60_000), "id string, last_ms long, beats long", "Append", "EventTime")


def expired_calls(calls: DataFrame, key: str, days: int, late: str = LATE) -> DataFrame:
    """(id, expired_ms) of the calls (id, key, at) of a stream that are older than days, at the end of the day at which they became so.

    Spread key so that no value holds much of the stream: a client rather than a surface.
    """
    rows = calls.where("at is not null").selectExpr("id", f"cast({key} as string) as owner", "at")
    return _timed(rows, "owner", late).transformWithState(Retention(days * 86_400_000), "id long, expired_ms long", "Append", "EventTime")
