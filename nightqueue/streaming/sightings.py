"""First sightings of objects in a stream, by event-time timers."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType, TimestampType

#: The state store that timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(t: datetime) -> int:
    return (t.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)


def spans_with(spans: list[list], stamps: list[int], gap: int) -> list[list]:
    """Spans [first, last, told] with stamps added; what lies at most `gap` apart is one span, told if a part was."""
    out: list[list] = []
    for first, last, told in sorted([*map(list, spans), *([t, t, False] for t in stamps)]):
        if out and first - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = max(out[-1][1], last), out[-1][2] or told
        else:
            out.append([first, last, told])
    return out


class FirstSighting(StatefulProcessor):
    """Of each object the spans of time in which it was seen, and whether a span's first stamp was told.

    A timer at the first stamp tells it when the watermark has passed it: no row that is on time can come
    before it then, and the day that it falls into isn't closed yet. A told span is forgotten when the
    watermark has passed its end by the gap: no row can belong to it any more."""

    def __init__(self, key: str, days: int):
        self.key, self.gap = key, days * 86_400_000_000

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("spans", "first array<long>, last array<long>, told array<boolean>")

    def spans(self) -> list[list]:
        old = self.state.get()
        return list(map(list, zip(*old))) if old else []

    def keep(self, spans: list[list]) -> None:
        if not spans:
            self.state.clear()
            return
        self.state.update(tuple(map(list, zip(*spans))))
        # timers count in milliseconds; a sighting is told when its own has passed in whole
        self.handle.registerTimer(min(-(-(last + self.gap if told else first) // 1000) for first, last, told in spans))

    def handleInputRows(self, key, rows, timerValues):
        self.keep(spans_with(self.spans(), [micros(r["stamp"]) for r in rows], self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, out, rest = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for first, last, told in self.spans():
            if not told and first <= now:
                out.append(Row(**{self.key: key[0], "stamp": EPOCH + timedelta(microseconds=first)}))
                told = True
            if not told or last + self.gap > now:
                rest.append([first, last, told])
        self.keep(rest)
        return iter(out)

    def close(self) -> None:
        pass


def first_sightings(rows: DataFrame, key: str, days: int) -> DataFrame:
    """key, stamp: an object's first stamp (append mode), and again the first one after more than `days` days without any.
    `rows` have a watermark on stamp; null keys take no part."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = StructType([StructField(key, rows.schema[key].dataType), StructField("stamp", TimestampType())])
    known = rows.where(f"`{key}` IS NOT NULL").groupBy(key)
    return known.transformWithState(statefulProcessor=FirstSighting(key, days), outputStructType=out, outputMode="Append", timeMode="EventTime", eventTimeColumnName="stamp")
