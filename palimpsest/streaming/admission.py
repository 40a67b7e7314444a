"""Admission of a stream of events: ids are held in state for a day, and a timer forgets them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.ordered import REMEMBERED
from .snapshots import PROVIDER

STATUS = "id string, ts timestamp, said long, status string"


class Admission(StatefulProcessor):
    """An id's accepted content and moment, until a timer at its end: the watermark has then passed all that it could meet."""

    def __init__(self, remembered: timedelta = REMEMBERED):
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "at timestamp, said long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.accepted.get() if self.accepted.exists() else None
        out = []
        for e in pd.concat(list(rows)).sort_values(["ts", "said"], kind="stable").itertuples(index=False):
            if held is None or e.ts - pd.Timestamp(held[0]) >= self.remembered:
                held = (e.ts.to_pydatetime(), int(e.said))
                status = "accepted"
            else:
                status = "duplicate" if e.said == held[1] else "conflict"
            out.append((key[0], e.ts, e.said, status))
        self.accepted.update(held)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int((pd.Timestamp(held[0]) + self.remembered).timestamp() * 1000))
        yield pd.DataFrame(out, columns=["id", "ts", "said", "status"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.accepted.clear()
        yield from ()

    def close(self) -> None:
        pass


def admitted(events: DataFrame, late: str = "1 hour", remembered: timedelta = REMEMBERED) -> DataFrame:
    """(id, ts, said, status) of a stream of events (id, aggregate_id, event_type, ts: a timestamp, payload); ``said`` is the content's hash."""
    events.sparkSession.conf.set(*PROVIDER)
    rows = events.filter("id IS NOT NULL AND ts IS NOT NULL").select("id", "ts", F.xxhash64("aggregate_id", "event_type", "payload").alias("said"))
    return rows.withWatermark("ts", late).groupBy("id").transformWithStateInPandas(Admission(remembered), StructType.fromDDL(STATUS), "Append", "EventTime")
