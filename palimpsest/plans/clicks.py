"""The log of clicks: snapshots every 100 events of a client, and the states that they lead to."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import snapshots
from ..sources.adapters import click_log
from ..sources.log import EventLog
from ..sources.store import scratch, stage_table
from ..streaming import events as streams
from ..streaming import snapshots as stream_of


def _log(spark, sf_dir):
    return stage_table(snapshots.numbered(click_log(spark, sf_dir)), "log")


def _plain(states):
    """The payload as its digest: texts differ in length alone otherwise."""
    return states.withColumn("payload", F.md5("payload"))


def log_snapshots(spark, sf_dir):
    return _plain(snapshots.snapshots(_log(spark, sf_dir)))


def stream_snapshots(spark, sf_dir):
    """The same from the log as a stream, by keyed state."""
    log = stage_table(click_log(spark, sf_dir), "clicks")
    return _plain(streams.materialised(stream_of.snapshots(streams.read(spark, log._staged, log.schema))))


def snapshot_states(spark, sf_dir):
    """The state after every event, from the snapshot before it."""
    log = _log(spark, sf_dir)
    return _plain(snapshots.states(log, snapshots.snapshots(log)))


def rehydrated(spark, sf_dir):
    """Every client's state now, from the last snapshot and the events after it."""
    log = _log(spark, sf_dir)
    taken = snapshots.snapshots(log)
    return _plain(snapshots.rehydrated(taken, snapshots.tail(log, taken)))


def retained(spark, sf_dir):
    """The same from a log on disk of which all but the last 90 days before the end of May are folded and dropped."""
    log = EventLog(spark, scratch(spark, "log"))
    log.append(click_log(spark, sf_dir))
    log.retain(date(2024, 5, 31))
    log.compact()
    return _plain(log.state())


_LOG = """log AS (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY ts NULLS FIRST, id) AS n FROM (SELECT DISTINCT click_id::VARCHAR AS id, 'node:shop:c' || client_id AS aggregate_id,
    CASE kind WHEN 'signup' THEN 'node_created' WHEN 'view' THEN 'node_updated' WHEN 'error' THEN 'node_deleted' WHEN 'purchase' THEN 'node_restored' WHEN 'click' THEN 'relation_added' END AS event_type, ts, props AS payload
    FROM clicks WHERE client_id IS NOT NULL)),
  marks AS (SELECT *, coalesce(event_type IN ('node_created', 'node_updated'), false) AS w, max(CASE WHEN event_type = 'node_restored' THEN n END) OVER (PARTITION BY aggregate_id ORDER BY n) AS back FROM log),
  fold AS (SELECT aggregate_id, n, count(*) FILTER (w) OVER (PARTITION BY aggregate_id ORDER BY n) AS version, max(CASE WHEN w THEN n END) OVER (PARTITION BY aggregate_id ORDER BY n) AS said,
    min(CASE WHEN event_type = 'node_deleted' THEN n END) OVER (PARTITION BY aggregate_id, back ORDER BY n) AS gone FROM marks),
  states AS (SELECT f.aggregate_id, f.n AS sequence_number, f.version, md5(p.payload) AS payload, d.ts AS deleted_at, d.id AS deleted_by
    FROM fold f LEFT JOIN log p ON p.aggregate_id = f.aggregate_id AND p.n = f.said LEFT JOIN log d ON d.aggregate_id = f.aggregate_id AND d.n = f.gone)"""
_SNAPSHOTS = f"WITH {_LOG} SELECT aggregate_id, sequence_number, 100::BIGINT AS event_count, version, payload, deleted_at, deleted_by FROM states WHERE sequence_number % 100 = 0"
_NOW = f"WITH {_LOG} SELECT * FROM states QUALIFY sequence_number = max(sequence_number) OVER (PARTITION BY aggregate_id)"
QUERIES = {"log_snapshots": log_snapshots, "stream_snapshots": stream_snapshots, "snapshot_states": snapshot_states, "rehydrated": rehydrated, "retained": retained}
SQL = {"log_snapshots": _SNAPSHOTS, "stream_snapshots": _SNAPSHOTS, "snapshot_states": f"WITH {_LOG} SELECT * FROM states", "rehydrated": _NOW, "retained": _NOW}
