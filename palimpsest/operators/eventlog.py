"""The event log: validation, and state as folds over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The event types that exist.
EVENT_TYPES = """
node_created node_updated node_deleted node_restored relation_added relation_removed relation_updated snapshot_created
embedding_recomputed dimension_changed
""".split()
AGGREGATE = r"^(node|sprint|team):[^\s:]+:[^\s:]+\z"


def error() -> Column:
    """What is wrong with an event, or null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    parsed = F.try_parse_json("payload")
    kind = F.schema_of_variant(parsed)
    return (
        F.when(blank("aggregate_id"), "aggregate_id is blank")
        .when(blank("event_type"), "event_type is blank")
        .when(parsed.isNull() | ~F.startswith(kind, F.lit("OBJECT<")) | (kind == "OBJECT<>"), "payload is no object with entries")
        .when(~F.col("aggregate_id").rlike(AGGREGATE), "aggregate_id is not type:project:id")
        .when(~F.col("event_type").isin(EVENT_TYPES), "event_type is unknown")
    )


def validated(events: DataFrame) -> DataFrame:
    return events.withColumn("error", error()).withColumn("valid", F.col("error").isNull())


def counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def tombstones(events: DataFrame) -> DataFrame:
    """(node_id, event_id, deleted_at, reason): the first delete after a node's latest restore.

    Restores are reduced by node before the join and deletes after it; equal moments go by the event's id.
    """
    back = events.filter("event_type = 'node_restored'").groupBy("aggregate_id").agg(F.max(F.struct("ts", "id")).alias("back"))
    deletes = events.filter("event_type = 'node_deleted'").select("aggregate_id", "ts", "id", "payload").join(back, "aggregate_id", "left")
    later = deletes.filter(F.col("back").isNull() | (F.struct("ts", "id") > F.col("back")))
    first = later.groupBy(F.col("aggregate_id").alias("node_id")).agg(F.min_by(F.struct("id", "ts", "payload"), F.struct("ts", "id")).alias("d"))
    return first.select("node_id", F.col("d.id").alias("event_id"), F.col("d.ts").alias("deleted_at"), field("$.reason", payload="d.payload").alias("reason"))


def latest_payloads(events: DataFrame) -> DataFrame:
    """(node_id, payload, version): what the last created or updated event says, and how many there were."""
    writes = events.filter("event_type in ('node_created', 'node_updated')")
    return writes.groupBy(F.col("aggregate_id").alias("node_id")).agg(F.max_by("payload", F.struct("ts", "id")).alias("payload"), F.count("*").alias("version"))


def active_nodes(events: DataFrame) -> DataFrame:
    return latest_payloads(events).join(tombstones(events).select("node_id"), "node_id", "left_anti")


def field(path: str, kind: str = "string", payload: str = "payload") -> Column:
    """A value of a JSON payload; null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(payload), path, kind)


def created_in(events: DataFrame, project: str | None, gone: DataFrame) -> DataFrame:
    """Nodes created in a project, or in any, and not tombstoned, one row a creation."""
    of = field("$.project_id")
    nodes = events.filter((F.col("event_type") == "node_created") & (of.isNotNull() if project is None else of == project))
    return nodes.join(gone.select(F.col("node_id").alias("aggregate_id")), "aggregate_id", "left_anti")


def tasks(events: DataFrame, project: str | None = None) -> DataFrame:
    """(project, id, seq, depends_on, priority, due_date) of the nodes created in a project, or in any, in the order of their events."""
    made = created_in(events, project, tombstones(events)).withColumn("project", field("$.project_id"))
    order = Window.partitionBy("project").orderBy("ts", "id")
    return made.select(
        "project", F.col("aggregate_id").alias("id"), F.row_number().over(order).alias("seq"), F.coalesce(field("$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"),
        field("$.priority", "int").alias("priority"), field("$.due_date").alias("due_date"),
    )


def admitted(events: DataFrame) -> DataFrame:
    """``events`` with status: of the rows of one id the earliest is accepted, what says the same is a duplicate, anything else a conflict.

    The accepted row is found by aggregates that combine before the shuffle, so an id with very many rows gathers nowhere
    but in the join that tells each of them.
    """
    said = F.xxhash64("aggregate_id", "event_type", "payload")
    rows = events.withColumn("_said", said)
    first = rows.groupBy("id").agg(F.min(F.struct("ts", "_said")).alias("_first"), F.count("*").alias("_n"))
    # equal rows of one moment: one of them is accepted, counted off within (id, content, moment)
    again = rows.groupBy("id", "_said", "ts", "aggregate_id", "event_type", "payload").agg(F.count("*").alias("_same"))
    told = again.join(first, "id").withColumn("_is", F.struct("ts", "_said") == F.col("_first"))
    kinds = F.when(F.col("_is"), F.concat(F.array(F.lit("accepted")), F.array_repeat(F.lit("duplicate"), (F.col("_same") - 1).cast("int")))).otherwise(
        F.array_repeat(F.when(F.col("_said") == F.col("_first._said"), "duplicate").otherwise("conflict"), F.col("_same").cast("int"))
    )
    return told.select("id", "aggregate_id", "event_type", "ts", "payload", F.explode(kinds).alias("status"))


def active_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target): added between two of ``nodes`` (id), once each, and never removed in either direction."""
    ends = relations.filter("source is not null and target is not null and event_type in ('relation_added', 'relation_removed')")
    # a row a pair of ends, whichever way it was added or removed
    forth, added = F.col("source") <= F.col("target"), F.col("event_type") == "relation_added"
    pairs = ends.groupBy(F.least("source", "target").alias("one"), F.greatest("source", "target").alias("two")).agg(F.bool_or(~added).alias("gone"), F.bool_or(added & forth).alias("forth"), F.bool_or(added & ~forth).alias("back"))
    ways = F.filter(F.array(F.when(F.col("forth"), F.struct(F.col("one").alias("source"), F.col("two").alias("target"))), F.when(F.col("back"), F.struct(F.col("two").alias("source"), F.col("one").alias("target")))), lambda w: w.isNotNull())
    known = pairs.filter("NOT gone").select("one", "two", ways.alias("ways"))
    for end in ("one", "two"):
        known = known.join(nodes.select(F.col("id").alias(end)).hint("shuffle_hash"), end, "left_semi")
    return known.select(F.explode("ways").alias("way")).select("way.source", "way.target")


def relations(events: DataFrame) -> DataFrame:
    """(event_type, source, target) of the relations that a log adds or removes, from the payloads."""
    rows = events.filter(F.col("event_type").isin("relation_added", "relation_removed"))
    return rows.select("event_type", field("$.source").alias("source"), field("$.target").alias("target"))


def graph_of(events: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of a project, or of all: nodes created in it and not tombstoned, and the active relations between them."""
    nodes = created_in(events, project, tombstones(events)).select(F.col("aggregate_id").alias("id")).distinct()
    return active_edges(relations(events), nodes), nodes
