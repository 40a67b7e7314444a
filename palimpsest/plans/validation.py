"""Propensity matching, bootstrap, admission with a limit, re-embedding, held-out edges and anonymous names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.hashing import anonymised, is_anonymised, padded_keys
from ..operators import eventlog, graph, ordered, propensity
from ..sources.adapters import event_log, graph_nodes, graph_relations, table
from ..sources.store import stage_table
from ..streaming import admission
from ..streaming import events as streams
from .graph import _GRAPH

#: Fixed values of the queries: keys of names, one longer than a block.
KEYS = {"k1": "a first key", "k2": "a second key, which is longer than the sixty-four bytes that a block of SHA-256 takes in"}


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), (F.col("c_mktsegment") == "BUILDING").alias("treated"), (F.col("c_acctbal") / F.lit(1000.0)).alias("logit"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 97).alias("outcome")
    )


def caliper_match(spark, sf_dir):
    return propensity.matched(_customers(spark, sf_dir))


def propensity_validated(spark, sf_dir):
    return propensity.validated(_customers(spark, sf_dir), ("balance", "nation"))


def bootstrap(spark, sf_dir):
    found = propensity.replicates(_customers(spark, sf_dir), effect="balance")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def anonymous_names(spark, sf_dir):
    """Each customer's name under both keys, and whether it is told again from its name and not from another."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", *[anonymised(F.col("c_name"), key, k).alias(k) for k, key in KEYS.items()], "c_name")
    return rows.select("c_custkey", *KEYS, is_anonymised(F.col("k2"), F.col("c_name"), KEYS).alias("known"), is_anonymised(F.col("k1"), F.concat("c_name", F.lit("x")), KEYS).alias("other"))


def held_out_edges(spark, sf_dir):
    nodes = graph_nodes(spark, sf_dir)
    return graph.held_out(stage_table(eventlog.active_edges(graph_relations(spark, sf_dir), nodes), "edges"))


def _keyed(spark, sf_dir):
    """Events under an idempotency key a user, whose content is the event's type."""
    return event_log(spark, sf_dir).select(F.col("aggregate_id").alias("id"), "aggregate_id", "event_type", "ts", F.lit("{}").alias("payload"))


def admitted_within(spark, sf_dir):
    return ordered.admitted_within(_keyed(spark, sf_dir)).groupBy("id", "event_type", "status").agg(F.count("*").alias("n"))


def stream_admitted(spark, sf_dir):
    """The same from a stream, whose state forgets an id by a timer."""
    rows = stage_table(_keyed(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "keyed")
    found = streams.materialised(admission.admitted(streams.read(spark, rows._staged, rows.schema)))
    return found.groupBy("id", "status").agg(F.count("*").alias("n"))


def reembedding(spark, sf_dir):
    """Losses of nodes drawn from the events."""
    losses = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("event_id") * 7919 % 271 / F.lit(1000.0)).alias("loss"), "event_id")
    return ordered.reembedding(losses).filter("reembed").select("node_id", "event_id")


_ADMITTED = """RECURSIVE e AS MATERIALIZED (SELECT 'node:p' || (user_id % 10) || ':u' || user_id AS id, CASE event_type WHEN 'signup' THEN 'node_created' WHEN 'view' THEN 'node_updated' WHEN 'error' THEN 'node_deleted'
      WHEN 'purchase' THEN 'node_restored' WHEN 'click' THEN 'relation_added' ELSE event_type END AS event_type, ts, event_id FROM events),
  acc(id, t0) AS (SELECT id, min(ts) FROM e GROUP BY 1 UNION ALL SELECT e.id, min(e.ts) FROM acc a JOIN e ON e.id = a.id AND e.ts >= a.t0 + INTERVAL 24 HOUR GROUP BY e.id, a.t0),
  first AS (SELECT a.id, a.t0, e.event_type FROM (SELECT DISTINCT * FROM acc) a JOIN e ON e.id = a.id AND e.ts = a.t0),
  said AS (SELECT e.id, e.event_type, CASE WHEN e.ts = f.t0 THEN 'accepted' WHEN e.event_type = f.event_type THEN 'duplicate' ELSE 'conflict' END AS status FROM e ASOF JOIN first f ON f.id = e.id AND e.ts >= f.t0)"""
_HMAC = {}
for _k, _key in KEYS.items():
    _inner, _outer = ("".join(f"\\x{b:02X}" for b in k) for k in padded_keys(_key))
    _HMAC[_k] = f"'anon:' || substr(sha256('{_outer}'::BLOB || unhex(sha256('{_inner}'::BLOB || encode(c_name)))), 1, 32) || ':{_k}'"
_COIN = "('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


def _times(b: int) -> str:
    total, out = 0.0, []
    for k in range(12):
        total += math.exp(-1) / math.factorial(k)
        out.append(f"WHEN {_COIN.format(f"c_custkey || ':boot{b}'")} < {total!r} THEN {k}")
    return f"CASE {' '.join(out)} ELSE 12 END"


QUERIES = {
    "caliper_match": caliper_match, "propensity_validated": propensity_validated, "bootstrap": bootstrap, "anonymous_names": anonymous_names, "held_out_edges": held_out_edges, "admitted_within": admitted_within, "stream_admitted": stream_admitted, "reembedding": reembedding,
}
SQL = {
    "caliper_match": f"""WITH n AS (SELECT c_custkey AS seq, c_mktsegment = 'BUILDING' AS treated, c_acctbal / 1000.0::DOUBLE AS x FROM customer), s AS (SELECT {propensity.CALIPER} * stddev_pop(x) AS most FROM n),
      near AS (SELECT t.seq, arg_min(c.seq, (abs(t.x - c.x), c.seq)) AS control, min(abs(t.x - c.x)) AS d FROM n t JOIN n c ON t.treated AND NOT c.treated GROUP BY 1)
      SELECT min(seq) AS seq, control FROM near, s WHERE d <= most GROUP BY control""",
    "bootstrap": "SELECT " + ", ".join(f"round(sum({_times(b)} * c_acctbal) / sum({_times(b)}), 6) AS b{b}" for b in range(propensity.REPLICATES)) + " FROM customer",
    "anonymous_names": f"SELECT c_custkey, {_HMAC['k1']} AS k1, {_HMAC['k2']} AS k2, true AS known, false AS other FROM customer",
    "held_out_edges": f"""WITH {_GRAPH}, e AS (SELECT source, target, s.degree + t.degree AS d FROM edges JOIN deg s ON s.id = source JOIN deg t ON t.id = target), n AS (SELECT count(*) AS n FROM e),
      q AS (SELECT source, target, ntile(4) OVER (ORDER BY d, source, target)::INT AS stratum FROM e),
      r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {_COIN.format("source || ':' || target || ':held'")}, source, target) AS k, count(*) OVER (PARTITION BY stratum) AS size FROM q)
      SELECT source, target, stratum, k <= greatest(1, floor(size * CASE WHEN n < 50 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END)) AS validation FROM r, n""",
    "admitted_within": f"WITH {_ADMITTED} SELECT id, event_type, status, count(*) AS n FROM said GROUP BY ALL",
    "stream_admitted": f"WITH {_ADMITTED} SELECT id, status, count(*) AS n FROM said GROUP BY ALL",
    "reembedding": """WITH RECURSIVE l AS (SELECT user_id, event_id, ts, event_id * 7919 % 271 / 1000.0::DOUBLE AS loss, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id * 7919 % 271) AS k FROM events),
      m AS MATERIALIZED (SELECT *, loss > 0.25 AS alarm, k >= 3 AND min(loss) OVER (PARTITION BY user_id ORDER BY k ROWS 2 PRECEDING) > 0.15 AS strike FROM l),
      walk(user_id, k, last, fires, event_id) AS (SELECT user_id, 0::BIGINT, NULL::TIMESTAMP, false, NULL::BIGINT FROM (SELECT DISTINCT user_id FROM m)
        UNION ALL SELECT m.user_id, m.k, CASE WHEN alarm OR strike AND (last IS NULL OR ts > last + INTERVAL 6 HOUR) THEN ts ELSE last END, alarm OR strike AND (last IS NULL OR ts > last + INTERVAL 6 HOUR), m.event_id
        FROM walk w JOIN m ON m.user_id = w.user_id AND m.k = w.k + 1)
      SELECT user_id AS node_id, event_id FROM walk WHERE fires""",
}
