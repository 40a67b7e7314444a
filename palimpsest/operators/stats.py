"""Counts over all tables of the engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dimension
from ..functions.text import has_tokens
from .eventlog import latest_payloads, tombstones


def memory_stats(memories: DataFrame) -> DataFrame:
    """One pass: active, forgotten, indexed (active with tokens) memories, and vectors (one a live memory)."""
    alive = ~F.col("forgotten")
    return memories.agg(
        F.count_if(alive).alias("active"), F.count_if("forgotten").alias("forgotten"), F.count_if(alive & has_tokens(F.lower("content"))).alias("indexed"), F.count_if(alive).alias("vectors")
    )


def system(memories: DataFrame, versions: DataFrame, events: DataFrame, constraints: DataFrame, results: DataFrame) -> DataFrame:
    """(name, value): one row a count, over all tables."""
    of = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [memory_stats(memories), node_stats(events).drop("nodes", "live_nodes"), of(versions, "versions"), of(constraints, "constraints"), of(results, "causal_analyses")]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in one.columns])
    return one.select(F.explode(pairs).alias("pair")).select("pair.*")


def node_stats(events: DataFrame) -> DataFrame:
    """Events, embedded nodes, tombstones, nodes that are embedded and not tombstoned, and the dimension they ask for.

    ``active_nodes`` is the difference of both counts, as clients expect it; ``live_nodes`` the exact number.
    """
    nodes, gone = latest_payloads(events).select("node_id"), tombstones(events).select("node_id")
    parts = [
        events.agg(F.count("*").alias("events")), nodes.agg(F.count("*").alias("nodes")), gone.agg(F.count("*").alias("tombstoned")), nodes.join(gone, "node_id", "left_anti").agg(F.count("*").alias("live_nodes")),
    ]
    out = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each
    return out.withColumn("active_nodes", F.col("nodes") - F.col("tombstoned")).withColumn("target_dim", dimension(F.col("nodes")))
