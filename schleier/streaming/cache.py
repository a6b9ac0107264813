"""Results that expire: each document's result lives for a while from its making, and can be extended up to a limit.

``lifetimes`` is the rule as columns; ``expiring`` keeps results as keyed state with processing-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL, EXTENSION, LIMIT = 900, 3600, 43_200
MOST_ENTRIES = 100


def remaining(expires: Column, now: Column) -> Column:
    """Whole seconds left, not below 0."""
    return F.greatest(F.floor(expires - now), F.lit(0)).cast("int")


def extended(created: Column, expires: Column, now: Column, extension: int = EXTENSION, limit: int = LIMIT) -> Column:
    """The new end: so long from now, but not past the limit from the making, and never earlier than before; null if it is over."""
    return F.when(now < expires, F.greatest(expires, F.least(now + extension, created + limit)))


def can_extend(created: Column, expires: Column, now: Column, extension: int = EXTENSION, limit: int = LIMIT) -> Column:
    return F.coalesce(extended(created, expires, now, extension, limit) > expires, F.lit(False))


def lifetimes(entries: DataFrame, now: Column, most: int = MOST_ENTRIES) -> DataFrame:
    """Entries (key, created, expires) that are alive at ``now``, the oldest beyond ``most`` evicted."""
    alive = entries.where(F.col("expires") > now)
    newest = alive.orderBy(F.desc("created"), "key").limit(most)
    return newest.withColumns({"remaining": remaining(F.col("expires"), now), "can_extend": can_extend(F.col("created"), F.col("expires"), now)})


class Expiring(StatefulProcessor):
    """The latest result of each key, dropped when its time is over.

    Commands are ``put`` (a new result, for ``ttl`` seconds but never beyond ``limit``), ``extend`` (``extension`` seconds from now, up to
    ``limit`` from its making, never sooner than before) and ``discard``. Reading never extends. A timer drops what nobody asks for.
    """

    def __init__(self, ttl: int = TTL, extension: int = EXTENSION, limit: int = LIMIT) -> None:
        self.ttl, self.extension, self.limit = ttl, extension, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("result", "result string, created long, expires long")

    def _row(self, key, event: str, held: tuple | None, now: int) -> pd.DataFrame:
        result, created, expires = held or (None, None, None)
        left = max(0, (expires - now) // 1000) if held else 0
        return pd.DataFrame({"key": [key[0]], "event": [event], "result": [result], "remaining": [int(left)], "can_extend": [bool(held and expires < created + 1000 * self.limit)]})

    def _keep(self, result: str, created: int, expires: int) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.value.update((result, created, expires))
        self.handle.registerTimer(expires)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for batch in rows:
            for command, result in zip(batch["command"], batch["result"]):
                held = self.value.get() if self.value.exists() else None
                if held and held[2] <= now:
                    self.value.clear()
                    held = None
                if command == "put":
                    self._keep(result, now, now + 1000 * min(self.ttl, self.limit))
                elif command == "extend" and held:
                    self._keep(held[0], held[1], max(held[2], min(now + 1000 * self.extension, held[1] + 1000 * self.limit)))
                elif command == "discard":
                    self.value.clear()
                held = self.value.get() if self.value.exists() else None
                yield self._row(key, command if held or command == "discard" else "gone", held, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.value.exists() and self.value.get()[2] <= now:
            self.value.clear()
            yield self._row(key, "expired", None, now)

    def close(self) -> None:
        pass


def expiring(commands: DataFrame, ttl: int = TTL, extension: int = EXTENSION, limit: int = LIMIT) -> DataFrame:
    """A stream of (key, command, result) as (key, event, result, remaining, can_extend), with each key's result kept as state."""
    return commands.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Expiring(ttl, extension, limit), outputStructType="key string, event string, result string, remaining long, can_extend boolean", outputMode="update", timeMode="processingTime"
    )
