"""The life of a story on a stream: born, dormant after a day without a match, woken by the next one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DORMANT_AFTER_HOURS = 24
_HOUR_MS = 3_600_000


class StoryLife(StatefulProcessor):
    """Per story: its slug, which never changes, the time of its last match, and whether it sleeps.

    A timer at the end of the quiet time puts a story to sleep when the watermark passes
    it, rows or no rows. Rows of one batch are taken in order of time; a row that is late
    but not too late moves nothing back. State of a story that slept for ``forget_days`` is
    let go by a second timer, so state is bounded by the stories of so many days.
    """

    def __init__(self, quiet_hours: int = DORMANT_AFTER_HOURS, forget_days: int = 30):
        self.quiet, self.forget = quiet_hours * _HOUR_MS, forget_days * 24 * _HOUR_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "slug string, last long, dormant boolean")

    def _timers(self, last: int, dormant: bool) -> None:
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last + (self.forget if dormant else self.quiet))

    @staticmethod
    def _rows(story: int, rows: list[tuple[str, str, int]]) -> pd.DataFrame:
        at = pd.to_datetime(pd.Series([r[2] for r in rows], dtype="int64"), unit="ms", utc=True)
        return pd.DataFrame({"story": pd.Series([story] * len(rows), dtype="int64"), "slug": [r[0] for r in rows], "status": [r[1] for r in rows], "at": at})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat([r[["at", "slug"]] for r in rows])
        came["ms"] = came["at"].dt.as_unit("ms").astype("int64")
        slug, last, dormant = self.life.get() if self.life.exists() else (None, None, False)
        out = []
        for ms, name in sorted(zip(came["ms"].tolist(), came["slug"].tolist(), strict=True)):
            if last is None:
                slug = name
                out.append((slug, "born", ms))
            elif ms - last >= self.quiet:
                out += [] if dormant else [(slug, "dormant", last + self.quiet)]
                out.append((slug, "woken", ms))
                dormant = False
            elif dormant:  # too late to have kept it awake
                continue
            last = ms if last is None else max(last, ms)
        self.life.update((slug, last, dormant))
        self._timers(last, dormant)
        if out:
            yield self._rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        slug, last, dormant = self.life.get()
        if dormant:
            self.life.clear()
            return
        self.life.update((slug, last, True))
        self.handle.registerTimer(last + self.forget)
        yield self._rows(key[0], [(slug, "dormant", last + self.quiet)])


def story_life(matches: DataFrame, late: str, quiet_hours: int = DORMANT_AFTER_HOURS, forget_days: int = 30) -> DataFrame:
    """(story, slug, status, at): each turn in the life of each story of a stream of (story, at, slug).

    ``status`` is born, dormant or woken. Needs a state store with timers: the session's
    ``spark.sql.streaming.stateStore.providerClass`` must be the RocksDB provider.
    """
    return matches.withWatermark("at", late).groupBy("story").transformWithStateInPandas(
        statefulProcessor=StoryLife(quiet_hours, forget_days), outputStructType="story long, slug string, status string, at timestamp", outputMode="Append", timeMode="EventTime"
    )
