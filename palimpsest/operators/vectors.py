"""Structural features, their embedding in the Poincaré ball, and nearest neighbours."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.binding import let
from ..functions.hashing import bucket10
from ..functions.temporal import recency
from ..functions.text import preview, tokens, word_count


def content_features(now: datetime | str) -> Column:
    """Length, distinct tokens, tags, project and age of a memory, each from 0 to 1."""
    return F.array(
        F.least(F.lit(1.0), word_count(F.col("content")) / 200.0),
        let(tokens(F.col("content")), lambda t: F.size(F.array_distinct(t)) / F.greatest(F.lit(1), F.size(t))),
        F.least(F.greatest(F.size(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(0)), F.lit(10)) / 10.0,
        bucket10(F.col("project")) / 10.0,
        recency(F.col("created_at"), now),
    )


def node_features() -> Column:
    """Priority, tags, author and complexity of a node; what is no number is missing, and a missing feature embeds to the origin."""
    number = lambda c, d: F.coalesce(F.col(c).try_cast("double"), F.lit(float(d)))
    return F.array(number("priority", 0), number("n_tags", 0), bucket10(F.coalesce("author", F.lit(""))).cast("double"), number("complexity", 5))


def nearest(vectors: DataFrame, source: DataFrame, k: int, most: int = 20, exclude: DataFrame | None = None) -> DataFrame:
    """(id, distance): the k nearest of ``vectors`` (id, vector) to the single row of ``source``; itself and ``exclude`` left out.

    An unknown source gives no rows. One row is broadcast; each task keeps its k best.
    """
    k = max(1, min(most, k))
    if exclude is not None:
        vectors = vectors.join(exclude.select("id"), "id", "left_anti")
    point = source.select(F.col("id").alias("_id"), F.col("vector").alias("_to")).limit(1)
    near = vectors.crossJoin(F.broadcast(point)).filter(F.col("id") != F.col("_id"))
    near = near.withColumn("_d", geometry.distance(F.col("vector"), F.col("_to")))
    return near.orderBy("_d", "id").limit(k).withColumn("distance", F.round("_d", 4)).drop("_id", "_to", "_d", "vector")


def similar_memories(memories: DataFrame, memory_id: object, now: datetime | str, k: int = 5, project: str | None = None) -> DataFrame:
    """(id, distance, content_preview) of the memories most like one of them in structure."""
    held = memories.filter(~F.col("forgotten")).select("id", "project", "content", geometry.embed(content_features(now)).alias("vector"))
    source = held.filter(F.col("id") == memory_id)
    inside = held if project is None else held.filter(F.col("project") == project)
    return nearest(inside, source, k).select("id", "distance", preview(F.col("content")).alias("content_preview"))


def similar_to_text(memories: DataFrame, text: str, tags: list[str], project: str, now: datetime | str, k: int = 5) -> DataFrame:
    """Neighbours of a text that is no memory yet."""
    spark = memories.sparkSession
    row = spark.range(1).select(F.lit(None).cast("string").alias("id"), F.lit(text).alias("content"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"), F.lit(project).alias("project"), F.lit(str(now)).cast("timestamp_ntz").alias("created_at"))
    held = memories.filter(~F.col("forgotten")).select("id", geometry.embed(content_features(now)).alias("vector"))
    point = row.select(geometry.embed(content_features(now)).alias("_to"))
    near = held.crossJoin(F.broadcast(point)).withColumn("_d", geometry.distance(F.col("vector"), F.col("_to")))
    return near.orderBy("_d", "id").limit(max(1, min(20, k))).select("id", F.round("_d", 4).alias("distance"))


def similar_nodes(nodes: DataFrame, node_id: object, k: int = 5, tombstones: DataFrame | None = None) -> DataFrame:
    """(id, distance) of the nodes most like one of them; tombstoned ones are left out, as source too."""
    held = nodes.select("id", geometry.embed(node_features()).alias("vector"))
    if tombstones is not None:
        held = held.join(tombstones.select(F.col("node_id").alias("id")), "id", "left_anti")
    return nearest(held, held.filter(F.col("id") == node_id), k, most=50).select("id", "distance")
