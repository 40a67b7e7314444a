"""Bodies of other systems made from the tables, as events; titles and tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalised
from ..sources import foreign
from ..sources.adapters import table

TENANT = "shop"


def _told(events):
    """Events with what their payload tells, but for their random ids."""
    got = lambda path, name: F.get_json_object("payload", path).alias(name)
    return events.select("aggregate_id", "event_type", "ts", got("$.node_type", "node_type"), got("$.relations[0].target", "target"), *[got(f"$.attributes.{c}", c) for c in ("title", "author", "additions", "status", "assignee", "text", "user", "reaction")], F.get_json_object("metadata", "$.source").alias("source"))


def _bodies(spark, sf_dir):
    """Orders as pull requests."""
    orders = table(spark, sf_dir, "orders")
    pr = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").alias("additions"), F.lit(0).alias("deletions"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("created_at"), F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("login")).alias("user"))
    body = F.struct(F.when(F.col("o_orderstatus") == "O", "opened").otherwise("closed").alias("action"), F.struct(F.col("o_custkey").alias("id")).alias("repository"), pr.alias("pull_request"))
    return orders.select(F.to_json(body).alias("body"), F.col("o_orderkey").alias("delivery_id"))


def pull_request_events(spark, sf_dir):
    return _told(foreign.pull_requests(_bodies(spark, sf_dir), TENANT)).select("aggregate_id", "event_type", "ts", "node_type", "target", "title", "author", "source")


def issue_events(spark, sf_dir):
    """Clients as issues, every row a revision, one row of them twice."""
    clients = table(spark, sf_dir, "clients")
    fields = F.struct(F.col("name").alias("summary"), F.struct(F.col("segment").alias("name")).alias("status"), F.lit("2024-01-01T00:00:00").alias("created"), F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"), F.when(F.col("city").isNotNull(), F.struct(F.col("city").alias("displayName"))).alias("assignee"))
    bodies = clients.select(F.to_json(F.struct(F.col("client_id").cast("string").alias("id"), F.concat(F.lit("K-"), F.col("client_id").cast("string")).alias("key"), fields.alias("fields"))).alias("body"))
    return _told(foreign.issues(bodies.unionByName(bodies), TENANT)).groupBy("aggregate_id", "ts", "event_type", "node_type", "source").agg(F.count("*").alias("n"))


def message_events(spark, sf_dir):
    """Clicks as messages: errors come from a bot, signups are reactions; some moments can't be read."""
    clicks = table(spark, sf_dir, "clicks")
    moment = F.when(F.col("click_id") % 17 == 0, "soon").otherwise(F.format_string("%d.%06d", F.lit(1704067200) + F.col("click_id"), F.col("click_id") % 1000000))
    event = F.struct(F.when(F.col("kind") == "signup", "reaction_added").otherwise("message").alias("type"), moment.alias("ts"), F.col("kind").alias("text"), F.col("client_id").cast("string").alias("user"), F.when(F.col("kind") == "error", "b").alias("bot_id"))
    bodies = clicks.select(F.to_json(F.struct(F.lit("event_callback").alias("type"), event.alias("event"))).alias("body"))
    return _told(foreign.messages(bodies, TENANT)).groupBy("aggregate_id", "event_type", "ts", "text", "user", "target", "source").agg(F.count("*").alias("n"))


def tenant_events(spark, sf_dir):
    """The clicks of one kind as a tenant's, whose metadata name it."""
    rows = table(spark, sf_dir, "clicks").select("click_id", F.to_json(F.struct(F.col("kind").alias("tenant_id"))).alias("metadata"))
    return foreign.of_tenant(rows, "purchase").groupBy("click_id").agg(F.count("*").alias("n"))


def normalised_titles(spark, sf_dir):
    people = table(spark, sf_dir, "clients").select("name").unionByName(table(spark, sf_dir, "vendors").select("name")).distinct()
    return people.select("name", normalised(F.concat(F.lit("  "), "name", F.lit(" \t"))).alias("title"))


QUERIES = {"pull_request_events": pull_request_events, "issue_events": issue_events, "message_events": message_events, "tenant_events": tenant_events, "normalised_titles": normalised_titles}
SQL = {
    "pull_request_events": """SELECT 'node:shop:pr_' || o_orderkey AS aggregate_id, CASE WHEN o_orderstatus = 'O' THEN 'node_created' ELSE 'node_updated' END AS event_type, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
      'pull_request' AS node_type, 'node:shop:repo_' || o_custkey AS target, 'Order ' || o_orderkey AS title, 'c' || o_custkey AS author, 'github_webhook' AS source FROM orders WHERE o_orderdate IS NOT NULL AND o_orderkey IS NOT NULL""",
    "issue_events": """WITH r AS (SELECT DISTINCT client_id, date_trunc('second', updated_at) AS ts FROM clients WHERE client_id IS NOT NULL AND updated_at IS NOT NULL)
      SELECT 'node:shop:jira_' || client_id AS aggregate_id, ts, CASE WHEN ts = TIMESTAMP '2024-01-01' THEN 'node_created' ELSE 'node_updated' END AS event_type, 'jira_issue' AS node_type, 'jira_rest' AS source, count(*) AS n FROM r GROUP BY ALL""",
    "message_events": """WITH m AS (SELECT *, (1704067200 + click_id) || '.' || lpad((click_id % 1000000)::VARCHAR, 6, '0') AS stamp FROM clicks WHERE click_id IS NOT NULL AND click_id % 17 <> 0 AND kind IS DISTINCT FROM 'error')
      SELECT 'node:shop:slack_' || stamp AS aggregate_id, CASE WHEN kind = 'signup' THEN 'relation_added' ELSE 'node_created' END AS event_type, make_timestamp((1704067200 + click_id) * 1000000 + click_id % 1000000) AS ts,
        coalesce(kind, '') AS text, client_id::VARCHAR AS "user", 'node:shop:slack_user_' || coalesce(client_id::VARCHAR, 'None') AS target, 'slack_events_api' AS source, count(*) AS n FROM m GROUP BY ALL""",
    "tenant_events": "SELECT click_id, count(*) AS n FROM clicks WHERE kind = 'purchase' GROUP BY 1",
    "normalised_titles": r"SELECT name, trim(regexp_replace(strip_accents(lower(name)), '[^\x00-\x7F]', '', 'g')) AS title FROM (SELECT name FROM clients UNION SELECT name FROM vendors)",
}
