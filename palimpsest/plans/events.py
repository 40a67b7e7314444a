"""The event log over ``events``: validation, folds and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import commands, eventlog, stats
from ..sources.adapters import event_log, table
from ..streaming import events as streams

#: Variants of an event that validation must tell apart, chosen by its number.
_BROKEN = ("node:a b:c", "bad_id", "", "node:a:b\n", "team:x:y")


def _odd(spark, sf_dir):
    e = event_log(spark, sf_dir)
    k = F.col("id") % 11
    broken = F.when(k < 5, F.element_at(F.array(*[F.lit(x) for x in _BROKEN]), (k + 1).cast("int"))).otherwise(F.col("aggregate_id"))
    kind = F.when(k == 5, "node_exploded").when(k == 6, " ").otherwise(F.col("event_type"))
    payload = F.when(k == 7, "{}").when(k == 8, "[1]").when(k == 9, "{broken").otherwise(F.col("payload"))
    return e.select("id", broken.alias("aggregate_id"), kind.alias("event_type"), "ts", payload.alias("payload"))


def validate_events(spark, sf_dir):
    return eventlog.validated(_odd(spark, sf_dir)).select("id", "valid", "error")


#: Of identifiers that add_event gives: version 7, made at this moment.
NOW, NOW_MS = "2024-02-01 00:00:00", 1706745600000
_UUID7 = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def add_event_command(spark, sf_dir):
    """Answers for every event, broken ones too, whether each new id has its form and moment, and whether its row is appended."""
    answers, _ = commands.add_events(_odd(spark, sf_dir).select("aggregate_id", "event_type", "payload"), NOW)
    moment = F.conv(F.replace(F.substring("id", 1, 13), F.lit("-"), F.lit("")), 16, 10).cast("long")
    return answers.select("aggregate_id", "valid", "error", (F.rlike("id", F.lit(_UUID7)) & (moment == NOW_MS)).alias("uuid7"))


def admitted_events(spark, sf_dir):
    """Every event, each fifth sent again, each seventh sent again with another payload."""
    e = event_log(spark, sf_dir).select("id", "aggregate_id", "event_type", "ts", "payload")
    later = F.col("ts") + F.make_dt_interval(mins=F.lit(1))
    other = e.filter("id % 7 = 0").withColumn("payload", F.lit('{"k": -1}')).withColumn("ts", later)
    return eventlog.admitted(e.unionByName(e.filter("id % 5 = 0")).unionByName(other)).select("id", "status")


def event_counts(spark, sf_dir):
    return eventlog.counts(event_log(spark, sf_dir))


def tombstones(spark, sf_dir):
    return eventlog.tombstones(event_log(spark, sf_dir)).select("node_id", "event_id", "deleted_at")


def latest_payload(spark, sf_dir):
    return eventlog.latest_payloads(event_log(spark, sf_dir))


def active_nodes(spark, sf_dir):
    return eventlog.active_nodes(event_log(spark, sf_dir))


def payload_fields(spark, sf_dir):
    return event_log(spark, sf_dir).select("id", eventlog.field("$.k", "long").alias("k"), eventlog.field("$.absent").alias("absent"))


def node_stats(spark, sf_dir):
    return stats.node_stats(event_log(spark, sf_dir))


def _stream(spark, sf_dir):
    raw = streams.read(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events").schema)
    return raw.select(F.col("event_id").alias("id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))


def stream_daily_counts(spark, sf_dir):
    """Daily counts of the stream, over all that is there."""
    return streams.materialised(streams.windowed_counts(_stream(spark, sf_dir)), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_deduplicated(spark, sf_dir):
    """Each event once, though all come twice."""
    s = _stream(spark, sf_dir)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return streams.materialised(streams.deduplicated(twice)).select("id", "event_type")


_KIND = "CASE event_type WHEN 'signup' THEN 'node_created' WHEN 'view' THEN 'node_updated' WHEN 'error' THEN 'node_deleted' WHEN 'purchase' THEN 'node_restored' WHEN 'click' THEN 'relation_added' ELSE event_type END"
_LOG = f"log AS (SELECT event_id AS id, 'node:p' || (user_id % 10) || ':u' || user_id AS aggregate_id, {_KIND} AS event_type, ts::TIMESTAMP AS ts, props AS payload FROM events)"
_TOMB = """back AS (SELECT aggregate_id, max((ts, id)) AS back FROM log WHERE event_type = 'node_restored' GROUP BY 1),
  gone AS (SELECT d.aggregate_id AS node_id, d.id AS event_id, d.ts AS deleted_at, row_number() OVER (PARTITION BY d.aggregate_id ORDER BY d.ts, d.id) AS n
    FROM log d LEFT JOIN back b ON b.aggregate_id = d.aggregate_id WHERE d.event_type = 'node_deleted' AND (b.back IS NULL OR (d.ts, d.id) > b.back))"""
_LATEST = """latest AS (SELECT aggregate_id AS node_id, payload, version FROM (SELECT aggregate_id, payload, row_number() OVER (PARTITION BY aggregate_id ORDER BY ts DESC, id DESC) AS n, count(*) OVER (PARTITION BY aggregate_id) AS version
  FROM log WHERE event_type IN ('node_created', 'node_updated')) WHERE n = 1)"""
QUERIES = {
    "validate_events": validate_events, "add_event_command": add_event_command, "admitted_events": admitted_events, "event_counts": event_counts, "tombstones": tombstones, "latest_payload": latest_payload, "active_nodes": active_nodes, "payload_fields": payload_fields, "node_stats": node_stats,
    "stream_daily_counts": stream_daily_counts, "stream_deduplicated": stream_deduplicated,
}
SQL = {
    "validate_events": """SELECT event_id AS id, event_id % 11 IN (4, 10) AS valid, CASE event_id % 11 WHEN 2 THEN 'aggregate_id is blank' WHEN 6 THEN 'event_type is blank'
      WHEN 7 THEN 'payload is no object with entries' WHEN 8 THEN 'payload is no object with entries' WHEN 9 THEN 'payload is no object with entries'
      WHEN 0 THEN 'aggregate_id is not type:project:id' WHEN 1 THEN 'aggregate_id is not type:project:id' WHEN 3 THEN 'aggregate_id is not type:project:id' WHEN 5 THEN 'event_type is unknown' END AS error FROM events""",
    "admitted_events": """SELECT event_id AS id, 'accepted' AS status FROM events UNION ALL SELECT event_id, 'duplicate' FROM events WHERE event_id % 5 = 0
      UNION ALL SELECT event_id, 'conflict' FROM events WHERE event_id % 7 = 0""",
    "event_counts": f"WITH {_LOG} SELECT event_type, count(*) AS n FROM log GROUP BY 1",
    "tombstones": f"WITH {_LOG}, {_TOMB} SELECT node_id, event_id, deleted_at FROM gone WHERE n = 1",
    "latest_payload": f"WITH {_LOG}, {_LATEST} SELECT * FROM latest",
    "active_nodes": f"WITH {_LOG}, {_TOMB}, {_LATEST} SELECT * FROM latest WHERE node_id NOT IN (SELECT node_id FROM gone)",
    "payload_fields": f"WITH {_LOG} SELECT id, (payload::JSON->>'$.k')::BIGINT AS k, payload::JSON->>'$.absent' AS absent FROM log",
    "node_stats": f"""WITH {_LOG}, {_TOMB}, {_LATEST}, c AS (SELECT (SELECT count(*) FROM log) AS events, (SELECT count(*) FROM latest) AS nodes, (SELECT count(*) FROM gone WHERE n = 1) AS tombstoned,
      (SELECT count(*) FROM latest WHERE node_id NOT IN (SELECT node_id FROM gone)) AS live_nodes)
      SELECT *, nodes - tombstoned AS active_nodes, CASE WHEN nodes < 50 THEN 32 ELSE least(128, greatest(16, ceil(4 * log2(nodes)))) END::INT AS target_dim FROM c""",
    "stream_daily_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_deduplicated": "SELECT event_id AS id, event_type FROM events",
}
SQL["add_event_command"] = f"""WITH v AS ({SQL['validate_events']})
  SELECT CASE event_id % 11 {' '.join(f"WHEN {k} THEN E'{x}'" for k, x in enumerate(x.replace(chr(10), chr(92) + 'n') for x in _BROKEN))} ELSE 'node:p' || (user_id % 10) || ':u' || user_id END AS aggregate_id, v.valid, v.error, true AS uuid7
  FROM events e JOIN v ON v.id = e.event_id"""
