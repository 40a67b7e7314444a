"""Task order under dependencies and priorities.

The order of a project is inherently sequential: its tasks are sorted into one
partition, and a worker orders the projects of its partition one after the other.
Projects spread over the cluster. All else is expressions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

LAST_PRIORITY, LAST_DATE = 99, "9999"


def merged_constraints(constraints: DataFrame) -> DataFrame:
    """(node_id, depends_on, priority) over dependency constraints: lists joined in the constraints' order, the least priority, 99 at most."""
    rows = constraints.filter("constraint_type = 'dependency'")
    return rows.groupBy("node_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("data.depends_on", F.array().cast("array<string>")).alias("d")))), lambda x: x["d"])).alias("depends_on"),
        F.least(F.lit(LAST_PRIORITY), F.min(F.coalesce("data.priority", F.lit(LAST_PRIORITY)))).alias("priority"),
    )


def with_constraints(tasks: DataFrame, merged: DataFrame) -> DataFrame:
    """``tasks`` (id, depends_on, priority, ...) with constraints: their lists replace a task's own, their priority fills a missing one."""
    held = merged.select(F.col("node_id").alias("id"), F.col("depends_on").alias("_d"), F.col("priority").alias("_p"))
    joined = tasks.join(held, "id", "left")
    return joined.withColumn("depends_on", F.coalesce("_d", "depends_on")).withColumn("priority", F.coalesce("priority", "_p")).drop("_d", "_p")


def _order_of(ids: list, depends: list, keys: list[tuple]) -> tuple[list, int]:
    """(ids in their order, how many of them have their turn) of a project's tasks in input order."""
    place = {x: i for i, x in enumerate(ids)}
    waits, opens = [0] * len(ids), [[] for _ in ids]
    for i, deps in enumerate(depends):
        for d in deps or ():
            if d in place:
                waits[i] += 1
                opens[place[d]].append(i)
    arrived = 0
    ready: list[tuple] = []

    def arrive(i: int) -> None:
        nonlocal arrived
        heapq.heappush(ready, (*keys[i], arrived, i))
        arrived += 1

    for i, n in enumerate(waits):
        if n == 0:
            arrive(i)
    done: list[int] = []
    while ready:
        i = heapq.heappop(ready)[-1]
        done.append(i)
        for j in opens[i]:
            waits[j] -= 1
            if waits[j] == 0:
                arrive(j)
    seen = set(done)
    return [ids[i] for i in done] + [x for i, x in enumerate(ids) if i not in seen], len(done)


def order(tasks: DataFrame) -> DataFrame:
    """(project, position, id, cycle): every project's tasks in order.

    A task is ready once all its dependencies within the project are done; of the ready ones the least (priority, due
    date) goes first, those that became ready earlier before others. Tasks on a cycle or behind one come last, marked.
    ``tasks`` has project, id, seq (input order), depends_on, priority, due_date; ids are unique within a project.
    A worker holds one project and one batch at a time.
    """
    cols = ["project", "id", "seq", "depends_on", "priority", "due_date"]
    rows = tasks.select(*cols).repartition("project").sortWithinPartitions("project", "seq", "id")
    kinds = rows.schema
    names = ["project", "position", "id", "cycle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def results(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """Orders of whole projects, which lie one after the other."""
            x = table.to_pydict()
            project, ids, depends = x["project"], x["id"], x["depends_on"]
            keys = [(LAST_PRIORITY if p is None else p, LAST_DATE if d is None else str(d)) for p, d in zip(x["priority"], x["due_date"], strict=True)]
            starts = [0, *(i for i in range(1, len(ids)) if project[i] != project[i - 1]), len(ids)] if ids else []
            out, position, cycle = [], [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                turn, n = _order_of(ids[a:b], depends[a:b], keys[a:b])
                out += turn
                position += range(1, b - a + 1)
                cycle += [False] * n + [True] * (b - a - n)
            yield from pa.table([table["project"], pa.array(position, pa.int32()), pa.array(out, table["id"].type), pa.array(cycle, pa.bool_())], names).to_batches()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            project = np.array(table["project"].to_pylist(), object)
            other = np.flatnonzero(project != project[-1])
            cut = int(other[-1]) + 1 if len(other) else 0  # the last project may go on
            if held and (cut or project[-1] != last):
                yield from results(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            elif cut:
                yield from results(table.slice(0, cut))
            held.append(table.slice(cut))
            last = project[-1]
        if held:
            yield from results(pa.concat_tables(held))

    return rows.mapInArrow(run, StructType([kinds["project"], StructField("position", IntegerType()), kinds["id"], StructField("cycle", BooleanType())]))


def ready_now(tasks: DataFrame) -> DataFrame:
    """(project, total_tasks, ready_now): ready are those without any dependency list, whether its tasks exist or not."""
    return tasks.groupBy("project").agg(F.count("*").alias("total_tasks"), F.count_if(F.coalesce(F.size("depends_on"), F.lit(0)) <= 0).alias("ready_now"))


def suggest(tasks: DataFrame, k: int = 5) -> DataFrame:
    """(project, suggested_order, total_tasks, ready_now): the first k tasks of each project."""
    first = order(tasks).filter(F.col("position") <= k).groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]).alias("suggested_order"))
    return ready_now(tasks).join(first, "project").select("project", "suggested_order", "total_tasks", "ready_now")
