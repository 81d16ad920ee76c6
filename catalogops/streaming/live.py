"""A live list of short-lived events as a stream with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from catalogops.operators.catalog import REACTIONS

#: Milliseconds that an event lives, and the most that live at once.
TTL_MS, NEWEST = 3000, 31
CHANGES = "key string, event_id long, value string, at_ms long, change string"


class LiveList(StatefulProcessor):
    """Keeps the live events of a key in a list state of at most ``newest`` entries and emits every change.

    An event enters at its own time.  It leaves ``ttl_ms`` later, by a timer of the watermark or ahead of a
    later event, or as the oldest when one too many enters.
    """

    def __init__(self, ttl_ms: int, newest: int):
        self.ttl_ms, self.newest = ttl_ms, newest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", "ts_ms long, event_id long, value string")

    def _gone(self, live: list[tuple], until: int) -> list[tuple]:
        """Changes of those whose time is over; ``live`` keeps the others."""
        over = [e for e in live if e[0] + self.ttl_ms <= until]
        live[:] = [e for e in live if e[0] + self.ttl_ms > until]
        return [(e[1], e[2], e[0] + self.ttl_ms, "out") for e in over]

    def _stored(self, key, live: list[tuple], changes: list[tuple]) -> Iterator[pd.DataFrame]:
        if live:
            self.live.put(live)
        else:
            self.live.clear()
        if changes:
            yield pd.DataFrame([(key[0], *c) for c in changes], columns=["key", "event_id", "value", "at_ms", "change"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        live = [tuple(e) for e in self.live.get()]
        new = sorted((int(t), int(i), v) for frame in rows for t, i, v in zip(frame["ts_ms"], frame["event_id"], frame["value"], strict=True))
        changes = []
        for event in new:
            changes += self._gone(live, event[0])
            live = sorted([*live, event])
            changes.append((event[1], event[2], event[0], "in"))
            for old in live[: max(0, len(live) - self.newest)]:
                changes.append((old[1], old[2], event[0], "out"))
            live = live[-self.newest :]
            self.handle.registerTimer(event[0] + self.ttl_ms)
        yield from self._stored(key, live, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live = [tuple(e) for e in self.live.get()]
        yield from self._stored(key, live, self._gone(live, expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def live_changes(
    events: DataFrame, key: str = "key", value: str = "value", allowed: tuple[str, ...] | None = REACTIONS, ttl_ms: int = TTL_MS, newest: int = NEWEST, watermark: str = "0 seconds"
) -> DataFrame:
    """Changes ``(key, event_id, value, at_ms, change)`` of each key's live list, for a stream of ``(ts, event_id, key, value)``.

    What has entered and not left by an instant is what ``catalog.active_at`` gives for it.  Values that are
    not allowed are rejected, as are rows with a null time or id; a null key is the empty one.  Events that come later than the watermark allows
    are dropped.  The state of a key is at most ``newest`` events and goes when the last one leaves.  Needs the
    RocksDB state store.
    """
    known = events.where(F.col("ts").isNotNull() & F.col("event_id").isNotNull())
    known = known.where(F.col(value).isin(*allowed)) if allowed else known
    rows = known.withWatermark("ts", watermark).select("ts", F.unix_millis("ts").alias("ts_ms"), "event_id", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(value).cast("string").alias("value"))
    return rows.groupBy("key").transformWithStateInPandas(LiveList(ttl_ms, newest), CHANGES, "Append", "EventTime")
