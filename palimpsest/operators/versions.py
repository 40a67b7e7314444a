"""Memories in time: an append-only log, version intervals and snapshots of past moments."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import at


def _moment() -> list:
    """What orders operations: their moment, then creation before update before forgetting, then content."""
    return [F.col("ts"), F.when(F.col("op") == "create", 0).when(F.col("op") == "update", 1).otherwise(2), F.col("content")]


def intervals(log: DataFrame) -> DataFrame:
    """(memory_id, content, valid_from, valid_to) of every content a memory had; the last one's end is null. Ends are exclusive.

    Of operations of one moment all but the last have an empty interval.
    """
    order = Window.partitionBy("id").orderBy(*_moment())
    return log.filter("op in ('create', 'update')").select(F.col("id").alias("memory_id"), "content", F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_to"))


def versions(log: DataFrame) -> DataFrame:
    """The superseded contents only."""
    return intervals(log).filter(F.col("valid_to").isNotNull())


def current(log: DataFrame) -> DataFrame:
    """The log folded to memories: last content, first and last moment, whether forgotten."""
    written, last = F.col("op") != "forget", F.struct(*_moment())
    return log.groupBy("id").agg(
        F.max_by("project", last).alias("project"), F.max_by(F.when(written, F.col("content")), F.when(written, last)).alias("content"),
        F.max_by(F.when(written, F.col("tags")), F.when(written, last)).alias("tags"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.bool_or(~written).alias("forgotten"),
    )


def snapshot(memories: DataFrame, history: DataFrame, when: datetime | str) -> DataFrame:
    """Memories as of a moment: those created by then and not yet forgotten, with the content they had.

    The moment is a literal, so both sides are filtered in their scans before they are joined on the id.
    """
    t = at(when)
    alive = memories.filter((F.col("created_at") <= t) & ~(F.col("forgotten") & (F.col("updated_at") <= t)))
    held = history.filter((F.col("valid_from") <= t) & (t < F.col("valid_to")))
    held = held.groupBy("memory_id").agg(F.min_by("content", "valid_from").alias("_old"))
    joined = alive.join(held, alive["id"] == held["memory_id"], "left")
    return joined.withColumn("content", F.coalesce("_old", "content")).drop("_old", "memory_id")
