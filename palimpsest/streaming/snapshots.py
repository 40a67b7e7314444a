"""Snapshots as the log grows: keyed state that emits one after every so many events of an aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.snapshots import DELETE, EVERY, RESTORE, WRITES

STATE = "number long, version long, payload string, deleted_at timestamp_ntz, deleted_by string"
SNAPSHOT = "aggregate_id string, sequence_number long, event_count long, version long, payload string, deleted_at timestamp_ntz, deleted_by string"
#: Spark keeps such state in this store alone.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Snapshotter(StatefulProcessor):
    """An aggregate's state; events of one micro-batch are taken by their moments, those of a later one after them."""

    def __init__(self, every: int = EVERY):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, version, payload, deleted_at, deleted_by = self.state.get() if self.state.exists() else (0, 0, None, None, None)
        out = []
        events = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable", na_position="first")
        for e in events.itertuples(index=False):
            number += 1
            if e.event_type in WRITES:
                version, payload = version + 1, e.payload
            elif e.event_type == RESTORE:
                deleted_at = deleted_by = None
            elif e.event_type == DELETE and deleted_by is None:
                deleted_at, deleted_by = None if pd.isna(e.ts) else e.ts.to_pydatetime(), str(e.id)
            if number % self.every == 0:
                out.append((key[0], number, self.every, version, payload, deleted_at, deleted_by))
        self.state.update((number, version, payload, deleted_at, deleted_by))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SNAPSHOT.split(", ")])

    def close(self) -> None:
        pass


def snapshots(events: DataFrame, every: int = EVERY) -> DataFrame:
    """The snapshots of a stream of events (id, aggregate_id, event_type, ts, payload)."""
    events.sparkSession.conf.set(*PROVIDER)
    rows = events.filter("aggregate_id IS NOT NULL").select("id", "aggregate_id", "event_type", "ts", "payload")
    return rows.groupBy("aggregate_id").transformWithStateInPandas(Snapshotter(every), StructType.fromDDL(SNAPSHOT), "Append", "None")
