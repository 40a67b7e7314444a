"""Snapshots of aggregates, and their state from the last snapshot and the events after it.

An aggregate's events have numbers from 1 on, in the order of their moments. Its state after an event is the last
payload written, how many writes there were, and the first delete after the latest restore. A fold over a stretch of
events is made of parts that combine, so that a block of ``EVERY`` events is one row of an aggregation, snapshots are
running combinations of blocks, and any state is a snapshot with the events of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stage_table

EVERY = 100
WRITES, DELETE, RESTORE = ("node_created", "node_updated"), "node_deleted", "node_restored"
#: What a state is made of besides its aggregate and number.
STATE = ("version", "payload", "deleted_at", "deleted_by")


def ranked(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rows``, staged, with ``name``: the place of each within ``by``, from 1 on, by ``order`` (a total one).

    Rows are dealt by ranges of (by, order), so that a key with very many rows spans tasks; places within a task are
    shifted by what the tasks before it hold of the key.
    """
    # ranges are cut from a sample of the rows; the task is written down, as a second run might cut otherwise
    dealt = stage_table(rows.repartitionByRange(by, *order).withColumn("_task", F.spark_partition_id()), "ordered")
    held = dealt.groupBy(by, "_task").agg(F.count("*").alias("_n"))
    earlier = held.select(F.col(by).alias("_by"), F.col("_task").alias("_of"), F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_task", by).orderBy(*order)))
    out = local.join(earlier, (F.col(by) == F.col("_by")) & (F.col("_task") == F.col("_of")))
    return out.select(*rows.columns, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def numbered(events: DataFrame) -> DataFrame:
    """Events (id, aggregate_id, event_type, ts, payload) with sequence_number; one without an aggregate goes."""
    return ranked(events.filter("aggregate_id IS NOT NULL").select("id", "aggregate_id", "event_type", "ts", "payload"), "aggregate_id", ["ts", "id"], "sequence_number")


def block_of(number: Column, every: int = EVERY) -> Column:
    return F.floor((number - 1) / every)


def folded(log: DataFrame, every: int = EVERY, more: tuple[str, ...] = ()) -> DataFrame:
    """(aggregate_id, block, *more, events, writes, last, restored, deleted): what each block of a numbered log does to a state.

    ``last`` is the last write, ``restored`` the number of the latest restore, ``deleted`` the first delete after it.
    A block is bounded, and so are the deletes that are held to find the one after the restore.
    """
    number, kind = F.col("sequence_number"), F.col("event_type")
    write, of = kind.isin(*WRITES), lambda k: kind == k
    made = F.struct(number.alias("at"), F.col("payload").alias("payload"))
    gone = F.struct(number.alias("at"), F.col("ts").alias("deleted_at"), F.col("id").alias("deleted_by"))
    blocks = log.withColumn("block", block_of(number, every)).groupBy("aggregate_id", "block", *more).agg(
        F.count("*").alias("events"), F.count_if(write).alias("writes"), F.max(F.when(write, made)).alias("last"), F.max(F.when(of(RESTORE), number)).alias("restored"), F.collect_list(F.when(of(DELETE), gone)).alias("_gone")
    )
    after = F.array_min(F.filter("_gone", lambda g: F.col("restored").isNull() | (g["at"] > F.col("restored"))))
    return blocks.withColumn("deleted", after).drop("_gone")


def _running(blocks: DataFrame) -> DataFrame:
    """Blocks with the state after each: a row a block goes through a window, not a row an event."""
    upto = Window.partitionBy("aggregate_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # a restore wipes out what was deleted before: stretches between restores
    rows = blocks.withColumn("_stretch", F.count("restored").over(upto))
    since = Window.partitionBy("aggregate_id", "_stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "aggregate_id", "block", F.sum("events").over(upto).alias("sequence_number"), "events", F.sum("writes").over(upto).alias("version"), F.max("last").over(upto)["payload"].alias("payload"), F.min("deleted").over(since).alias("_deleted")
    ).select("*", F.col("_deleted.deleted_at").alias("deleted_at"), F.col("_deleted.deleted_by").alias("deleted_by")).drop("_deleted")


def snapshots(log: DataFrame, every: int = EVERY) -> DataFrame:
    """(aggregate_id, sequence_number, event_count, *STATE): the state after each full block of a numbered log."""
    return _running(folded(log, every)).filter(F.col("events") == every).select("aggregate_id", "sequence_number", F.col("events").alias("event_count"), *STATE)


def _with_base(rows: DataFrame, taken: DataFrame, every: int) -> DataFrame:
    """Rows with the snapshot (columns with b_) that their block goes on from."""
    base = taken.select(F.col("aggregate_id").alias("b_aggregate"), (F.col("sequence_number") / every).cast("long").alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in STATE])
    return rows.join(base, (F.col("aggregate_id") == F.col("b_aggregate")) & (F.col("block") == F.col("b_block")), "left").drop("b_aggregate", "b_block")


def _joined(restored: Column, deleted: Column) -> list[Column]:
    """A state's deletion: kept from the snapshot unless a restore came after it, else the first of its own."""
    stays = restored.isNull() & F.col("b_deleted_by").isNotNull()
    return [F.when(stays, F.col(f"b_{c}")).otherwise(deleted[c]).alias(c) for c in ("deleted_at", "deleted_by")]


def states(log: DataFrame, taken: DataFrame, every: int = EVERY) -> DataFrame:
    """(aggregate_id, sequence_number, *STATE): the state after every event, from the snapshot before its block and the block's events up to it."""
    rows = log.withColumn("block", block_of(F.col("sequence_number"), every))
    upto = Window.partitionBy("aggregate_id", "block").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
    write, number = F.col("event_type").isin(*WRITES), F.col("sequence_number")
    rows = rows.select(
        "aggregate_id", "block", "sequence_number", F.count_if(write).over(upto).alias("_writes"), F.max(F.when(write, F.struct(number.alias("at"), "payload"))).over(upto).alias("_last"), F.max(F.when(F.col("event_type") == RESTORE, number)).over(upto).alias("_restored"),
        F.collect_list(F.when(F.col("event_type") == DELETE, F.struct(number.alias("at"), F.col("ts").alias("deleted_at"), F.col("id").alias("deleted_by")))).over(upto).alias("_gone"),
    )
    rows = rows.withColumn("_deleted", F.array_min(F.filter("_gone", lambda g: F.col("_restored").isNull() | (g["at"] > F.col("_restored")))))
    rows = _with_base(rows, taken, every)
    return rows.select(
        "aggregate_id", "sequence_number", (F.coalesce("b_version", F.lit(0)) + F.col("_writes")).alias("version"), F.when(F.col("_last").isNull(), F.col("b_payload")).otherwise(F.col("_last.payload")).alias("payload"), *_joined(F.col("_restored"), F.col("_deleted"))
    )


def tail(log: DataFrame, taken: DataFrame) -> DataFrame:
    """The events of a numbered log that come after their aggregate's last snapshot."""
    last = taken.groupBy(F.col("aggregate_id").alias("_of")).agg(F.max("sequence_number").alias("_last"))
    rows = log.join(last, F.col("aggregate_id") == F.col("_of"), "left")
    return rows.filter(F.col("_last").isNull() | (F.col("sequence_number") > F.col("_last"))).select(*log.columns)


def rehydrated(taken: DataFrame, rest: DataFrame, every: int = EVERY) -> DataFrame:
    """(aggregate_id, sequence_number, *STATE) now: each aggregate's last snapshot and the ``rest``, its tail, which is all of the log that is read."""
    last = taken.groupBy("aggregate_id").agg(F.max_by(F.struct("sequence_number", *STATE), "sequence_number").alias("s")).select(F.col("aggregate_id").alias("b_aggregate"), F.col("s.sequence_number").alias("b_number"), *[F.col(f"s.{c}").alias(f"b_{c}") for c in STATE])
    # the rest may be of several blocks: what it does as a whole
    latest = folded(rest, every).withColumn("_restored", F.max("restored").over(Window.partitionBy("aggregate_id")))
    new = latest.groupBy("aggregate_id").agg(
        F.sum("events").alias("events"), F.sum("writes").alias("writes"), F.max("last").alias("last"), F.max("restored").alias("restored"), F.min(F.when(F.col("_restored").isNull() | (F.col("deleted.at") > F.col("_restored")), F.col("deleted"))).alias("deleted")
    )
    out = new.join(last, F.col("aggregate_id") == F.col("b_aggregate"), "full_outer")
    count = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).cast("long")
    return out.select(
        F.coalesce("aggregate_id", "b_aggregate").alias("aggregate_id"), count("b_number", "events").alias("sequence_number"), count("b_version", "writes").alias("version"),
        F.when(F.col("last").isNull(), F.col("b_payload")).otherwise(F.col("last.payload")).alias("payload"), *_joined(F.col("restored"), F.col("deleted")),
    )
