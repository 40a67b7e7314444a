"""Rules that depend on what they decided before: one pass over sorted rows, with the state of one key at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: How long an accepted id is remembered.
REMEMBERED = timedelta(hours=24)
#: A loss that asks for a new embedding at once, one that does so three times in a row, and the rest between two of these.
EMERGENCY, STRIKE, STRIKES, COOLDOWN = 0.25, 0.15, 3, timedelta(hours=6)


def in_order(rows: DataFrame, by: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], object], name: str, kind: str) -> DataFrame:
    """``rows`` with ``name``: what ``step(state, row)`` gives, row by row of each ``by`` in ``order``; ``start()`` makes a key's state.

    Rows stream through a task, which holds one key's state, so that a key may have any number of them.
    """
    columns = rows.columns
    schema = StructType(rows.schema.fields).add(name, kind)
    arrow = to_arrow_schema(schema)
    at = columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or row[at] != key:
                    key, state = row[at], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow.field(name).type)], schema=pa.schema([*batch.schema, arrow.field(name)]))

    return rows.repartition(by).sortWithinPartitions(by, *order).mapInArrow(run, schema)


def admitted_within(events: DataFrame, remembered: timedelta = REMEMBERED) -> DataFrame:
    """``events`` (id, aggregate_id, event_type, ts, payload) with status. An id that is new, or whose acceptance is as old as ``remembered``, is accepted;
    until then the same content is a duplicate and any other a conflict. Rows of one moment go by their content's hash; rows without an id or a moment go.
    """
    rows = events.filter("id IS NOT NULL AND ts IS NOT NULL").withColumn("_said", F.xxhash64("aggregate_id", "event_type", "payload"))
    when, said = rows.columns.index("ts"), rows.columns.index("_said")

    def step(state: dict, row: tuple) -> str:
        if not state or row[when] - state["at"] >= remembered:
            state["at"], state["said"] = row[when], row[said]
            return "accepted"
        return "duplicate" if row[said] == state["said"] else "conflict"

    return in_order(rows, "id", ["ts", "_said"], dict, step, "status", "string").drop("_said")


def reembedding(losses: DataFrame) -> DataFrame:
    """``losses`` (node_id, ts, loss) with reembed: whether the node is to be embedded anew then.

    A loss above EMERGENCY asks for it at once; STRIKES losses in a row above STRIKE do if the last one that was asked
    for is more than COOLDOWN ago. Null losses break a row of strikes.
    """
    when, loss = losses.columns.index("ts"), losses.columns.index("loss")

    def step(state: dict, row: tuple) -> bool:
        x = row[loss]
        state["strikes"] = state.get("strikes", 0) + 1 if x is not None and x > STRIKE else 0
        fires = x is not None and x > EMERGENCY
        fires = fires or state["strikes"] >= STRIKES and ("last" not in state or row[when] - state["last"] > COOLDOWN)
        if fires:
            state["last"] = row[when]
        return fires

    return in_order(losses.filter("ts IS NOT NULL"), "node_id", ["ts", "loss"], dict, step, "reembed", "boolean")
