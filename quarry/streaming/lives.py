"""Notes that live for a while after their last renewal, with event-time timers: one keyed state, no batch twin needed to close it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "spark.sql.streaming.stateStore.providerClass"


def merged(lives: list[tuple[int, int, int]], times: list[int], ttl: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of lives after notes at these times: neighbours less than `ttl` apart are one life, in whatever order they come."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted([*lives, *((t, t, 1) for t in times)]):
        if out and first - out[-1][1] < ttl:
            a, b, m = out[-1]
            out[-1] = (a, max(b, last), m + n)
        else:
            out.append((first, last, n))
    return out


#: Groups that keys are dealt into. A group's keys are worked on together: calls of state and timers are as many as groups, not as keys or lives.
GROUPS = 1024


class _Lives(StatefulProcessor):
    """State of a group: its keys' lives that the watermark hasn't closed yet. Times are microseconds.

    A group has a timer for the life that ends first; when that fires, all that are over are told at once, and the next one's timer is set.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.lives = handle.getListState("lives", "note_key string, first long, last long, n long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.ttl) // 1000)

    def _keep(self, lives: list[tuple[str, int, int, int]]) -> None:
        if lives:
            self.lives.put(lives)
            self.handle.registerTimer(self._timer(min(x[2] for x in lives)))
        else:
            self.lives.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, list[int]] = {}
        for pdf in rows:
            for k, t in zip(pdf["note_key"].tolist(), pdf["note_micros"].tolist(), strict=True):
                fresh.setdefault(k, []).append(t)
        now, old = [], {}
        for k, *life in self.lives.get():
            if k in fresh:
                old.setdefault(k, []).append(tuple(life))
            else:
                now.append((k, *life))
        for k, times in fresh.items():
            now += [(k, *life) for life in merged(old.get(k, []), times, self.ttl)]
        self._keep(now)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)  # timers before the watermark are due
        over, left = [], []
        for x in self.lives.get():
            (over if self._timer(x[2]) <= at else left).append(tuple(x))
        if over:
            self._keep(left)
            names, first, last, n = zip(*over, strict=True)
            yield pd.DataFrame({"note_key": names, "opened": first, "until": [x + self.ttl for x in last], "notes": n})
        elif left:  # the life that the timer was for has been renewed
            self.handle.registerTimer(self._timer(min(x[2] for x in left)))

    def close(self) -> None:
        pass


def expiries(notes: DataFrame, keys: list[str], at: str, ttl_seconds: float, late: str = "1 hour") -> DataFrame:
    """keys, opened, until, notes (times in microseconds): a row for each life of a key that has expired.

    A note keeps its key alive for ttl_seconds; another one before that renews it, a later one opens a new life. A life is told when the watermark
    (the greatest time less `late`) has passed its end, so notes that come out of order within `late` are counted where they belong, and those
    later than that are dropped. Keys pass the state as JSON. Needs the RocksDB state store, which is set for the session.
    """
    notes.sparkSession.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = F.to_json(F.struct(*keys)).alias("note_key")
    rows = notes.withWatermark(at, late).select(F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int").alias("note_group"), own, at, F.unix_micros(F.col(at)).alias("note_micros"))
    told = rows.groupBy("note_group").transformWithStateInPandas(statefulProcessor=_Lives(int(ttl_seconds * 1e6)), outputStructType="note_key string, opened long, until long, notes long", outputMode="Append", timeMode="EventTime")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.select(*keys).schema)
    return told.select(F.from_json("note_key", kinds).alias("k"), "opened", "until", "notes").select("k.*", "opened", "until", "notes")
