"""Bodies that other systems send, as events of the log: pull requests, issues and messages.

Each takes a DataFrame with ``body`` (JSON text) and gives (event_id, aggregate_id, event_type, ts, payload, schema_version,
metadata), payload and metadata as JSON text. Bodies that can't be read, and those without what names their node or moment,
go. Repeated rows give an event each, but for issues, of which each revision counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uuid7

# fixed values: the shapes of the bodies, the names of kinds and sources
VERSION = "2.3"
_USER = "struct<login: string>"
PULL = f"action string, repository struct<id: bigint>, pull_request struct<id: bigint, title: string, state: string, additions: bigint, deletions: bigint, created_at: string, user: {_USER}>"
_NAMED = "struct<name: string>"
ISSUE = f"id string, key string, fields struct<summary: string, status: {_NAMED}, priority: {_NAMED}, assignee: struct<displayName: string>, created: string, updated: string, customfield_10016: double>"
MESSAGE = "type string, event struct<type: string, ts: string, text: string, user: string, channel: string, reaction: string, thread_ts: string, team: string, bot_id: string, subtype: string>"


def _moment(text: Column) -> Column:
    """A moment of ISO 8601 with or without a zone; without one it is UTC."""
    zoned = F.when(F.regexp_like(text, F.lit("(Z|[+-][0-9]{2}:?[0-9]{2})$")), text).otherwise(F.concat(text, F.lit("Z")))
    return F.to_utc_timestamp(F.try_to_timestamp(zoned), F.current_timezone()).cast("timestamp_ntz")


def _node(tenant: str, kind: str, *names: Column) -> Column:
    return F.concat(F.lit(f"node:{tenant}:{kind}_"), *[n.cast("string") for n in names])


def _events(rows: DataFrame, node: Column, kind: Column, ts: Column, node_type: str, attributes: list[Column], relations: list[Column], metadata: Column) -> DataFrame:
    parts = [F.lit(node_type).alias("node_type"), F.struct(*attributes).alias("attributes")]
    if relations:
        parts.append(F.array(*relations).alias("relations"))
    keep = {"ignoreNullFields": "false"}
    out = rows.select(node.alias("aggregate_id"), kind.alias("event_type"), ts.alias("ts"), F.to_json(F.struct(*parts), keep).alias("payload"), F.lit(VERSION).alias("schema_version"), F.to_json(metadata, keep).alias("metadata"))
    out = out.filter("aggregate_id IS NOT NULL AND ts IS NOT NULL")
    return out.select(uuid7(F.col("ts")).alias("event_id"), *out.columns)


def _relation(target: Column, kind: str) -> Column:
    return F.struct(target.alias("target"), F.lit(kind).alias("type"))


def pull_requests(rows: DataFrame, tenant: str) -> DataFrame:
    """Pull requests of ``rows`` (body, delivery_id): one that opens creates its node, all else updates it."""
    rows = rows.withColumn("b", F.from_json("body", PULL))
    pr = F.col("b.pull_request")
    return _events(
        rows, _node(tenant, "pr", pr["id"]), F.when(F.col("b.action") == "opened", "node_created").otherwise("node_updated"), _moment(pr["created_at"]), "pull_request",
        [*[pr[c].alias(c) for c in ("title", "state", "additions", "deletions")], pr["user"]["login"].alias("author")],
        [_relation(_node(tenant, "repo", F.col("b.repository.id")), "belongs_to")],
        F.struct(F.lit("github_webhook").alias("source"), F.col("delivery_id").cast("string").alias("delivery_id"), F.lit(tenant).alias("tenant_id")),
    )


def issues(rows: DataFrame, tenant: str) -> DataFrame:
    """Issues of ``rows`` (body): one that was never changed creates its node, all else updates it; of a revision's rows the least body counts."""
    rows = rows.withColumn("b", F.from_json("body", ISSUE)).filter("b.id IS NOT NULL AND b.fields.updated IS NOT NULL")
    rows = rows.groupBy(F.col("b.id").alias("_id"), F.col("b.fields.updated").alias("_of")).agg(F.min_by("b", "body").alias("b"))
    f = F.col("b.fields")
    return _events(
        rows, _node(tenant, "jira", F.col("b.id")), F.when(f["created"] == f["updated"], "node_created").otherwise("node_updated"), _moment(f["updated"]), "jira_issue",
        [F.col("b.key").alias("key"), f["summary"].alias("summary"), f["status"]["name"].alias("status"), f["priority"]["name"].alias("priority"), f["customfield_10016"].alias("story_points"), f["assignee"]["displayName"].alias("assignee")],
        [], F.struct(F.lit("jira_rest").alias("source"), F.col("b.id").alias("jira_id"), F.lit(tenant).alias("tenant_id")),
    )


def messages(rows: DataFrame, tenant: str) -> DataFrame:
    """Messages and reactions of ``rows`` (body); what a bot says, and messages of a subtype, go."""
    rows = rows.withColumn("e", F.from_json("body", MESSAGE)["event"]).filter("coalesce(e.bot_id, '') = '' AND coalesce(e.subtype, '') = ''")
    e = F.col("e")
    seconds = F.expr("try_cast(e.ts AS decimal(20, 6))")
    ts = F.to_utc_timestamp(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.current_timezone()).cast("timestamp_ntz")
    named = lambda kind, c: _node(tenant, kind, F.coalesce(c, F.lit("None")))
    return _events(
        rows, _node(tenant, "slack", e["ts"]), F.when(e["type"] == "reaction_added", "relation_added").otherwise("node_created"), ts, "slack_message",
        [F.coalesce(e["text"], F.lit("")).alias("text"), *[e[c].alias(c) for c in ("user", "channel", "reaction", "thread_ts")]],
        [_relation(named("slack_user", e["user"]), "authored_by"), _relation(named("slack_channel", e["channel"]), "posted_in")],
        F.struct(F.lit("slack_events_api").alias("source"), e["team"].alias("team_id"), F.lit(tenant).alias("tenant_id")),
    )


def of_tenant(events: DataFrame, tenant: str | None) -> DataFrame:
    """The events whose metadata name the tenant; none without a tenant, none of those whose metadata name nobody."""
    return events.filter(F.get_json_object("metadata", "$.tenant_id") == F.lit(tenant).cast("string"))
