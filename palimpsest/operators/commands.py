"""Commands as batches: each gives its answers and the rows to append; nothing is changed in place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uuid7
from ..functions.temporal import at
from ..functions.text import has_tokens, token_estimate
from .eventlog import validated

ENFORCED = ("dependency",)


def _stripped(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")


def remember(commands: DataFrame, now: datetime | str, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, log rows) of commands (id, content, project, tags): blank contents are refused; ids are new if missing.

    An answer tells how many memories are indexed (have tokens) once all of the batch are stored, ``held`` before it included, and that the memory is embedded.
    """
    rows = commands.select(F.coalesce(F.col("id"), uuid7(at(now))).alias("id"), F.coalesce("project", F.lit("default")).alias("project"), _stripped("content").alias("content"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    bad = F.col("content") == ""
    indexed = rows.filter(~bad).select("content")
    indexed = indexed if held is None else indexed.unionByName(held.filter(~F.col("forgotten")).select("content"))
    indexed = indexed.agg(F.count_if(has_tokens(F.lower("content"))).alias("_indexed"))  # one row
    told = lambda value: F.when(bad, F.lit(None)).otherwise(value)
    answers = rows.crossJoin(F.broadcast(indexed)).select(
        "id", "project", told(token_estimate(F.col("content"))).alias("token_estimate"), told(F.col("_indexed")).alias("indexed_terms"), told(F.lit(True)).alias("embedded"), F.when(bad, "error").otherwise("remembered").alias("status")
    )
    return answers, rows.filter(~bad).select(F.lit("create").alias("op"), "id", "project", "content", "tags", at(now).alias("ts"))


def _state(commands: DataFrame, memories: DataFrame) -> DataFrame:
    held = memories.select("id", F.col("project").alias("_project"), F.col("forgotten").alias("_forgotten"))
    return commands.join(held, "id", "left")


def forget(commands: DataFrame, memories: DataFrame, now: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(answers, log rows) of commands (id, reason): forgotten, not_found or already_forgotten."""
    rows = _state(commands.dropDuplicates(["id"]), memories)
    answers = rows.select("id", F.when(F.col("_forgotten").isNull(), "not_found").when(F.col("_forgotten"), "already_forgotten").otherwise("forgotten").alias("status"), F.coalesce("reason", F.lit("manual")).alias("reason"))
    gone = rows.filter(~F.col("_forgotten")).select(F.lit("forget").alias("op"), "id", F.col("_project").alias("project"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("array<string>").alias("tags"), at(now).alias("ts"))
    return answers, gone


def update(commands: DataFrame, memories: DataFrame, now: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(answers, log rows) of commands (id, content): an error for blank contents and for missing or forgotten memories."""
    rows = _state(commands, memories).withColumn("content", _stripped("content"))
    why = F.when(F.col("content") == "", "content is blank").when(F.col("_forgotten").isNull(), "memory is unknown").when(F.col("_forgotten"), "memory is forgotten")
    rows = rows.withColumn("detail", why)
    answers = rows.select("id", F.when(F.col("detail").isNull(), "updated").otherwise("error").alias("status"), "detail", F.when(F.col("detail").isNull(), token_estimate(F.col("content"))).alias("token_estimate"))
    log = rows.filter("detail is null").select(F.lit("update").alias("op"), "id", F.col("_project").alias("project"), "content", F.lit(None).cast("array<string>").alias("tags"), at(now).alias("ts"))
    return answers, log


def add_events(commands: DataFrame, now: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(answers, event rows) of commands (aggregate_id, event_type, payload); ids are time-ordered."""
    rows = validated(commands.select(uuid7(at(now)).alias("id"), "aggregate_id", "event_type", "payload"))
    answers = rows.select("id", "aggregate_id", "valid", "error")
    return answers, rows.filter("valid").select("id", "aggregate_id", "event_type", at(now).alias("ts"), "payload", F.lit("2.3").alias("schema_version"))


def add_constraints(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, constraint rows) of commands (id, node_id, constraint_type, depends_on, priority): any type is stored, dependencies are enforced."""
    enforced = F.col("constraint_type").isin(*ENFORCED)
    answers = commands.select(F.col("id").alias("constraint_id"), enforced.alias("enforced"), F.when(~enforced, F.format_string("constraint type %s is stored but not enforced", "constraint_type")).alias("warning"))
    priority = F.coalesce("priority", F.lit(1))
    data = F.struct(F.col("constraint_type").alias("type"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"), priority.alias("priority"))
    return answers, commands.select("id", "node_id", "constraint_type", priority.alias("priority"), data.alias("data"))
