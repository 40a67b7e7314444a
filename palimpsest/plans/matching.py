"""Matching over ``supplier`` and ``events``: splits, standardised scores, pairs and effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, stats, versions
from ..sources.adapters import customer_events, event_log, memories, memory_log, suppliers_as_nodes, table
from ..sources.store import Store, scratch
from .events import SQL as _EVENTS
from .memory import SQL as _MEMORY


def treatment_split(spark, sf_dir):
    """Events whose payload has k = 7, as a number; the text '7' would not do."""
    e = event_log(spark, sf_dir)
    return causal.split_counts(e.select(causal.treated({"k": 7}).alias("treated"))).select("treatment_n", "control_n")


def resolve_confounder(spark, sf_dir):
    return causal.confounder_of(event_log(spark, sf_dir), ("size", "k", "absent"))


def pooled_zscore(spark, sf_dir):
    return causal.standardised(suppliers_as_nodes(spark, sf_dir)).select("id", F.round("score", 6).alias("score"))


def causal_match(spark, sf_dir):
    return causal.match(causal.standardised(suppliers_as_nodes(spark, sf_dir))).select("treatment_id", "control_id")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "BUILDING").alias("treated"), F.col("c_acctbal").alias("confounder"), (F.col("c_custkey") % 97).alias("outcome")
    )


def causal_match_ranges(spark, sf_dir):
    """Customers of one segment with others of a like balance, over ranges of 300 customers."""
    return causal.match(causal.standardised(_customers(spark, sf_dir)), range_rows=300).select("treatment_id", "control_id")


def causal_ate(spark, sf_dir):
    return causal.effect(causal.match(causal.standardised(suppliers_as_nodes(spark, sf_dir)))).select("ate", "n", "status")


def analyze_causal(spark, sf_dir):
    return causal.analyze(suppliers_as_nodes(spark, sf_dir), "acctbal", "shade").select("ate", "n", "status", "confounder_used", "treatment_n", "control_n", "error", "interpretation")


def _results(spark, sf_dir):
    """The analysis appended to the results of a store, and that table read back."""
    store = Store(spark, scratch(spark, "store"))
    store.append("causal_results", causal.result_rows(causal.analyze(suppliers_as_nodes(spark, sf_dir), "acctbal", "shade"), "nation below 8", "acctbal"))
    return store.read("causal_results")


def analyze_log(spark, sf_dir):
    """Customers of one team against the others, from the payloads of an event log."""
    return causal.analyze_log(customer_events(spark, sf_dir), {"team": "BUILDING"}, "score").select("ate", "n", "status", "confounder_used", "treatment_n", "control_n", "error", "interpretation")


def causal_errors(spark, sf_dir):
    """Analyses that cannot be made: nobody on one side, and no confounder in any payload."""
    log = customer_events(spark, sf_dir)
    cases = (("side", {"team": "NOBODY"}, causal.CONFOUNDERS), ("confounder", {"team": "BUILDING"}, ("absent",)))
    out = [causal.analyze_log(log, conditions, "score", named).select(F.lit(case).alias("case"), "error", "status", "treatment_n", "control_n") for case, conditions, named in cases]
    return out[0].unionByName(out[1])


def causal_results(spark, sf_dir):
    return _results(spark, sf_dir).drop("id")


def system_stats(spark, sf_dir):
    constraints = table(spark, sf_dir, "orders")  # each order is a constraint
    return stats.system(memories(spark, sf_dir), versions.versions(memory_log(spark, sf_dir)), event_log(spark, sf_dir), constraints, _results(spark, sf_dir))


def causal_status(spark, sf_dir):
    return spark.range(0, 41).select(F.col("id").alias("n"), causal.status(F.col("id")).alias("status"))


def balance(spark, sf_dir):
    return causal.imbalance(suppliers_as_nodes(spark, sf_dir)).select(F.round("smd", 6).alias("smd"))


_NODES = "nodes AS (SELECT s_suppkey AS id, s_nationkey < 8 AS treated, (s_suppkey * 37 % 101)::DOUBLE AS x, s_acctbal AS y FROM supplier)"
_SCORED = f"{_NODES}, scored AS (SELECT id, treated, y, CASE WHEN stddev_pop(x) OVER () < 1e-9 THEN 0 ELSE (x - avg(x) OVER ()) / stddev_pop(x) OVER () END AS score FROM nodes)"
_CUSTOMERS = "nodes AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS treated, c_acctbal AS x, 0 AS y FROM customer)"
_PAIRS = """treats AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM scored WHERE treated), controls AS (SELECT * FROM scored WHERE NOT treated),
  steps AS (
    SELECT 0::BIGINT AS n, []::BIGINT[] AS used, []::BIGINT[] AS ts
    UNION ALL
    SELECT s.n + 1, CASE WHEN count(c.id) > 0 THEN list_append(s.used, arg_min(c.id, (abs(t.score - c.score), c.id))) ELSE s.used END, CASE WHEN count(c.id) > 0 THEN list_append(s.ts, t.id) ELSE s.ts END
    FROM steps s JOIN treats t ON t.n = s.n + 1 LEFT JOIN controls c ON abs(t.score - c.score) < 0.5 AND NOT list_contains(s.used, c.id) GROUP BY s.n, s.used, s.ts, t.id
  ), pairs AS (SELECT unnest(ts) AS treatment_id, unnest(used) AS control_id FROM (SELECT * FROM steps ORDER BY n DESC LIMIT 1))"""
_MATCH = f"{_SCORED}, {_PAIRS}"
_STATUS = "CASE WHEN n >= 30 THEN 'counterfactual_validated' WHEN n >= 10 THEN 'observational' ELSE 'hypothesis' END"
_EFFECT = f"{_MATCH}, e AS (SELECT coalesce(round(avg(t.y) - avg(c.y), 3), 0) AS ate, count(*) AS n FROM pairs p JOIN scored t ON t.id = p.treatment_id JOIN scored c ON c.id = p.control_id)"
QUERIES = {
    "treatment_split": treatment_split, "resolve_confounder": resolve_confounder, "pooled_zscore": pooled_zscore, "causal_match": causal_match, "causal_match_ranges": causal_match_ranges, "causal_ate": causal_ate, "analyze_causal": analyze_causal, "causal_status": causal_status, "balance": balance, "causal_results": causal_results, "analyze_log": analyze_log, "causal_errors": causal_errors, "system_stats": system_stats,
}
SQL = {
    "treatment_split": "SELECT count(*) FILTER (props::JSON->>'$.k' = '7') AS treatment_n, count(*) FILTER (props::JSON->>'$.k' <> '7') AS control_n FROM events",
    "resolve_confounder": "SELECT CASE WHEN bool_or((props::JSON->'$.size') IS NOT NULL) THEN 'size' WHEN bool_or((props::JSON->'$.k') IS NOT NULL) THEN 'k' END AS confounder FROM events",
    "pooled_zscore": f"WITH {_SCORED} SELECT id, round(score, 6) AS score FROM scored",
    "causal_match": f"WITH RECURSIVE {_MATCH} SELECT treatment_id, control_id FROM pairs",
    "causal_match_ranges": f"WITH RECURSIVE {_SCORED.replace(_NODES, _CUSTOMERS)}, {_PAIRS} SELECT treatment_id, control_id FROM pairs",
    "causal_ate": f"WITH RECURSIVE {_EFFECT} SELECT ate, n, {_STATUS} AS status FROM e",
    "analyze_causal": f"""WITH RECURSIVE {_EFFECT}, c AS (SELECT count(*) FILTER (treated) AS treatment_n, count(*) FILTER (NOT treated) AS control_n FROM nodes)
      , d AS (SELECT *, CASE WHEN least(treatment_n, control_n) < 3 THEN 'too few samples on one side' WHEN n = 0 THEN 'no match within the caliper' END AS error FROM e CROSS JOIN c)
      SELECT ate, n, {_STATUS} AS status, 'shade' AS confounder_used, treatment_n, control_n, error,
        CASE WHEN error IS NULL THEN format('Treatment effect: {{:+.3f}} on acctbal ({{}}, {{}} matched pairs, confounder: shade)', ate, {_STATUS}, n) END AS interpretation FROM d""",
    "causal_status": "SELECT range AS n, CASE WHEN range >= 30 THEN 'counterfactual_validated' WHEN range >= 10 THEN 'observational' ELSE 'hypothesis' END AS status FROM range(0, 41)",
    "balance": f"WITH {_NODES} SELECT round((avg(x) FILTER (treated) - avg(x) FILTER (NOT treated)) / sqrt((var_pop(x) FILTER (treated) + var_pop(x) FILTER (NOT treated)) / 2), 6) AS smd FROM nodes",
}
SQL["causal_results"] = f"SELECT 'nation below 8' AS treatment, 'acctbal' AS outcome, ate, n AS n_samples, status FROM ({SQL['analyze_causal']}) WHERE error IS NULL"
SQL["system_stats"] = f"""WITH one AS (SELECT m.*, e.events, e.tombstoned, e.active_nodes, e.target_dim, (SELECT count(*) FROM conversations) - (SELECT count(DISTINCT conv_id) FROM conversations) AS versions,
    (SELECT count(*) FROM orders) AS constraints, (SELECT count(*) FROM ({SQL['causal_results']})) AS causal_analyses FROM ({_MEMORY['memory_stats']}) m CROSS JOIN ({_EVENTS['node_stats']}) e)
  SELECT name, value::BIGINT AS value FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM one) ON COLUMNS(*) INTO NAME name VALUE value)"""

_LOG_NODES = "nodes AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS treated, c_acctbal AS x, (c_custkey % 97)::DOUBLE AS y FROM customer WHERE c_custkey % 11 <> 0)"
SQL["analyze_log"] = SQL["analyze_causal"].replace(_NODES, _LOG_NODES).replace("on acctbal", "on score").replace("confounder: shade", "confounder: size").replace("'shade'", "'size'")
SQL["causal_errors"] = f"""WITH {_LOG_NODES} SELECT 'side' AS case, 'too few samples on one side' AS error, NULL::VARCHAR AS status, 0 AS treatment_n, count(*) AS control_n FROM nodes
  UNION ALL SELECT 'confounder', 'no confounder in any payload', 'hypothesis', count(*) FILTER (treated), count(*) FILTER (NOT treated) FROM nodes"""
